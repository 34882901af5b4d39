"""Ordered licence signature rules, hand-written: priority class, label, keyword, weight, regex.

The regexes read the words of a text in lower case, joined by single spaces:
"Version 2.0" is ``version 2 0``. A rule is tried only where its keyword occurs.
Within the list, earlier rules win over later ones of the same priority class.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    priority: int
    order: int
    label: str
    keyword: str
    weight: float
    regex: re.Pattern


# Classes, most telling first: legal grant text, machine tags, addresses, notices, bare names.
GRANT, TAG, LINK, NOTICE, NAME = 5, 4, 3, 2, 1
WEIGHT = {GRANT: 0.95, TAG: 0.95, LINK: 0.9, NOTICE: 0.8, NAME: 0.5}

_GRANTS = """
mit|permission|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|merchantability|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0|permission|permission is hereby granted free of charge to any person obtaining a copy .{0,200}without restriction .{0,160}to permit persons to whom the software is furnished to do so the software is provided
isc|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
x11|x consortium|the name of the x consortium shall not be used in advertising
hpnd|permission|permission to use copy modify and distribute this software and its documentation for any purpose
bsd-2-clause|redistribution|redistributions? (?:of source code|in source and binary forms?).{0,900}redistributions in binary form must reproduce
bsd-3-clause|endorse|neither the names? of .{1,120}contributors may be used to endorse or promote products
bsd-4-clause|advertising|all advertising materials mentioning features or use of this software must display
apache-2|apache|licensed under the apache license version 2(?: 0)?
apache-2|apache|you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-1.1|apache|the end user documentation included with the redistribution .{0,160}apache software foundation
gpl-3|general public|either version 3 of the license or at your option any later version
gpl-2|general public|either version 2 of the license or at your option any later version
gpl-1|general public|either version 1 or at your option any later version
lgpl-2.1|lesser general|gnu lesser general public license .{0,120}either version 2 1
lgpl-3|lesser general|gnu lesser general public license .{0,120}either version 3
agpl-3|affero|gnu affero general public license .{0,120}either version 3
mpl-2|mozilla public|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1|mozilla public|the contents of this file are subject to the mozilla public license version 1 1
epl-1|eclipse public|this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2|eclipse public|this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cddl-1|common development|the contents of this file are subject to the terms of the common development and distribution license
zlib|altered|altered source versions must be plainly marked as such
bsl-1|organization|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense|unencumbered|this is free and unencumbered software released into the public domain
wtfpl|verbatim|everyone is permitted to copy and distribute verbatim or modified copies .{0,80}changing it is allowed as long as the name is changed
cc0-1|waive|affirmer hereby overtly fully permanently irrevocably and unconditionally waives
ofl-1.1|font|this font software is licensed under the sil open font license version 1 1
artistic-2|establishes|this license establishes the terms under which a given free software package may be copied modified distributed
python-2|python|psf is making python available to licensee on an as is basis
openssl|openssl|this product includes software developed by the openssl project
postgresql|postgresql|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ncsa|university|developed by .{1,60}university of illinois .{0,200}with the software without restriction
eupl-1.2|eupl|licensed under the eupl (?:version )?1 2
elastic-2|hosted or managed|you may not provide the software to third parties as a hosted or managed service
sspl-1|functionality|if you make the functionality of the program .{0,60}available to third parties as a service you must make the service source code available
busl-1.1|licensor|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
commons-clause|sell the software|the license does not include and the license does not grant to you the right to sell the software
proprietary|confidential|this (?:software|document|material) is (?:the )?(?:confidential and proprietary|proprietary and confidential)
all-rights-reserved|reproduc|no part of this (?:publication|work|document|book) may be reproduced
"""

_NAMES = """
mit|mit|under (?:the )?mit licen[cs]e
mit|mit|(?:the )?mit licen[cs]e(?:d)?
mit|expat|expat licen[cs]e
mit-0|mit|mit no attribution(?: licen[cs]e)?
isc|isc|isc licen[cs]e
0bsd|bsd|(?:zero clause bsd|bsd zero clause)
0bsd|free public|free public license 1 0 0
bsd-2-clause|bsd|(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-3-clause|bsd|(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsd-4-clause|bsd|(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
bsd|bsd|(?:under (?:the |a )?)?bsd(?: style)? licen[cs]e
apache-2|apache|apache licen[cs]e(?: version)? v?2(?: 0)?
apache-2|apache|apache (?:software )?licen[cs]e v2(?: 0)?
apache-2|apache|apache 2(?: 0)? licen[cs]e
apache-1.1|apache|apache (?:software )?licen[cs]e(?: version)? v?1 1
apache-1|apache|apache (?:software )?licen[cs]e(?: version)? v?1 0
apache|apache|apache (?:software )?licen[cs]e
gpl-3|general public|gnu general public licen[cs]e (?:version |v )?v?3(?: 0)?
gpl-2|general public|gnu general public licen[cs]e (?:version |v )?v?2(?: 0)?
gpl-3|gpl|(?:gnu )?gpl ?v?3(?: 0)?
gpl-2|gpl|(?:gnu )?gpl ?v?2(?: 0)?
gpl|gpl|gnu gpl
gpl|general public|(?:gnu )?general public licen[cs]e
lgpl-3|lesser general|(?:gnu )?lesser general public licen[cs]e (?:version |v )?v?3(?: 0)?
lgpl-2.1|lesser general|(?:gnu )?lesser general public licen[cs]e (?:version |v )?v?2 1
lgpl-2|library general|(?:gnu )?library general public licen[cs]e (?:version |v )?v?2(?: 0)?
lgpl-3|lgpl|(?:gnu )?lgpl ?v?3(?: 0)?
lgpl-2.1|lgpl|(?:gnu )?lgpl ?v?2 1
lgpl|lgpl|(?:gnu )?lgpl
lgpl|lesser general|(?:gnu )?lesser general public licen[cs]e
agpl-3|affero|(?:gnu )?affero general public licen[cs]e(?: version| v)? v?3(?: 0)?
agpl-3|agpl|(?:gnu )?agpl ?v?3(?: 0)?
agpl|affero|(?:gnu )?affero general public licen[cs]e
gfdl-1.3|documentation licen|(?:gnu )?free documentation licen[cs]e (?:version )?1 3
gfdl-1.2|documentation licen|(?:gnu )?free documentation licen[cs]e (?:version )?1 2
gfdl|documentation licen|(?:gnu )?free documentation licen[cs]e
mpl-2|mozilla public|mozilla public licen[cs]e(?: version)? v?2(?: 0)?
mpl-1.1|mozilla public|mozilla public licen[cs]e(?: version)? v?1 1
mpl-1|mozilla public|mozilla public licen[cs]e(?: version)? v?1 0
mpl|mozilla public|mozilla public licen[cs]e
epl-2|eclipse public|eclipse public licen[cs]e(?: version)? v?2(?: 0)?
epl-1|eclipse public|eclipse public licen[cs]e(?: version)? v?1(?: 0)?
edl-1|eclipse distribution|eclipse distribution licen[cs]e(?: version)? v?1(?: 0)?
cddl-1.1|common development|common development and distribution licen[cs]e(?: version)? v?1 1
cddl-1|common development|common development and distribution licen[cs]e
cpl-1|common public|common public licen[cs]e(?: version)?(?: v?1 0)?
ipl-1|ibm public|ibm public licen[cs]e(?: version)?(?: v?1 0)?
spl-1|sun public|sun public licen[cs]e
npl-1.1|netscape public|netscape public licen[cs]e
apsl-2|apple public|apple public source licen[cs]e
ms-pl|microsoft public|microsoft public licen[cs]e
ms-rl|microsoft reciprocal|microsoft reciprocal licen[cs]e
zlib|zlib|zlib(?: libpng)? licen[cs]e
libpng|libpng|libpng licen[cs]e
bsl-1|boost software|boost software licen[cs]e(?: version)?(?: 1 0)?
unlicense|unlicen|the unlicen[cs]e
wtfpl|wtfpl|wtfpl
beerware|beer|beer ?ware licen[cs]e
cc0-1|cc0|cc0(?: 1 0)?(?: universal)?
cc0-1|creative commons|creative commons (?:cc0|zero)(?: 1 0)?
cc-by-nc-nd|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?
cc-by-nc-sa|creative commons|creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc|creative commons|creative commons attribution non ?commercial(?: [1-4] 0)?
cc-by-nd|creative commons|creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?
cc-by-sa|creative commons|creative commons attribution share ?alike(?: [1-4] 0)?
cc-by|creative commons|creative commons attribution(?: [1-4] 0)?
cc|creative commons|creative commons licen[cs]e
cc-by-nc-nd|cc|cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa|cc|cc by nc sa(?: [1-4] 0)?
cc-by-nc|cc|cc by nc(?: [1-4] 0)?
cc-by-nd|cc|cc by nd(?: [1-4] 0)?
cc-by-sa|cc|cc by sa(?: [1-4] 0)?
cc-by|cc|cc by [1-4] 0
public-domain|public domain|(?:released|dedicated|placed|put) (?:in ?to|to|in) the public domain
public-domain|public domain|public domain dedication
pddl-1|open data commons|open data commons public domain dedication and licen[cs]e
odbl-1|open database|open database licen[cs]e
odc-by-1|open data commons|open data commons attribution licen[cs]e
cdla-permissive|community data|community data licen[cs]e agreement permissive
cdla-sharing|community data|community data licen[cs]e agreement sharing
ogl-uk-3|open government|open government licen[cs]e(?: v3 0)?
etalab-2|etalab|etalab(?: 2 0)?
etalab-2|ouverte|licence ouverte(?: 2 0)?
ofl-1.1|open font|(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
artistic-2|artistic|artistic licen[cs]e(?: version)? 2(?: 0)?
artistic-1|artistic|(?:perl )?artistic licen[cs]e(?: 1 0)?
python-2|python software|python software foundation licen[cs]e
ruby|ruby|ruby licen[cs]e
php-3|php|php licen[cs]e(?: version)?(?: 3 0 1?)?
zend-2|zend|zend (?:engine )?licen[cs]e
openssl|openssl|openssl licen[cs]e
postgresql|postgresql|postgresql licen[cs]e
ncsa|illinois|university of illinois ncsa open source licen[cs]e
w3c|w3c|w3c software (?:notice and )?licen[cs]e
afl-3|academic free|academic free licen[cs]e
osl-3|open software|open software licen[cs]e(?: 3 0)?
cecill-2.1|cecill|cecill(?: licen[cs]e)?(?: 2 1)?
eupl-1.2|european union public|european union public licen[cs]e(?: version)?(?: v?1 2)?
upl-1|universal permissive|universal permissive licen[cs]e
blueoak-1|blue oak|blue oak model licen[cs]e
mulan-psl-2|mulan|mulan permissive software licen[cs]e
vim|vim|vim licen[cs]e
tcl|tcl|tcl tk licen[cs]e
lppl-1.3|latex project|latex project public licen[cs]e
qpl-1|q public|q public licen[cs]e
sleepycat|sleepycat|sleepycat licen[cs]e
watcom-1|watcom|sybase open watcom public licen[cs]e
bsd-3-lbnl|lawrence berkeley|lawrence berkeley national labs bsd
elastic-2|elastic|elastic licen[cs]e(?: 2 0)?
sspl-1|server side|server side public licen[cs]e
busl-1.1|business source|business source licen[cs]e
commons-clause|commons clause|commons clause
polyform-nc|polyform|polyform noncommercial licen[cs]e
polyform-sb|polyform|polyform small business licen[cs]e
rail|rail|(?:open)?rail(?: m)? licen[cs]e
llama|llama|llama [23](?: [1-9])? community licen[cs]e
gemma|gemma|gemma terms of use
proprietary|proprietary|proprietary (?:software )?licen[cs]e
commercial|commercial|commercial licen[cs]e(?: agreement)?
all-rights-reserved|all rights|all rights reserved
"""

# Identifiers of machine tags: each gives one "SPDX-License-Identifier" rule and one "License:" field rule.
_TAGS = """
mit=mit isc=isc 0bsd=0bsd bsd-2-clause=bsd 2 clause, bsd-3-clause=bsd 3 clause, apache-2=apache 2 0, gpl-2=gpl 2 0, gpl-3=gpl 3 0,
lgpl-2.1=lgpl 2 1, lgpl-3=lgpl 3 0, agpl-3=agpl 3 0, mpl-2=mpl 2 0, mpl-1.1=mpl 1 1, epl-1=epl 1 0, epl-2=epl 2 0, cddl-1=cddl 1 0,
zlib=zlib, bsl-1=bsl 1 0, unlicense=unlicense, wtfpl=wtfpl, cc0-1=cc0 1 0, cc-by=cc by 4 0, cc-by-sa=cc by sa 4 0, cc-by-nc=cc by nc 4 0,
ofl-1.1=ofl 1 1, artistic-2=artistic 2 0, python-2=psf 2 0, postgresql=postgresql, eupl-1.2=eupl 1 2, ms-pl=ms pl
"""

_LINKS = """
apache-2|apache org|apache org licenses license 2 0
gpl-3|gnu org|gnu org licenses gpl 3 0
gpl-2|gnu org|gnu org licenses (?:old licenses )?gpl 2 0
lgpl-3|gnu org|gnu org licenses lgpl 3 0
lgpl-2.1|gnu org|gnu org licenses (?:old licenses )?lgpl 2 1
agpl-3|gnu org|gnu org licenses agpl 3 0
gpl|gnu org|gnu org (?:copyleft|licenses) gpl
mit|opensource org|opensource org licenses? mit
bsd-2-clause|opensource org|opensource org licenses? bsd 2 clause
bsd-3-clause|opensource org|opensource org licenses? bsd 3 clause
isc|opensource org|opensource org licenses? isc
mpl-2|mozilla org|mozilla org (?:en us )?mpl 2 0
epl-2|eclipse org|eclipse org legal epl (?:v )?2(?:0| 0)
epl-1|eclipse org|eclipse org legal epl v10
bsl-1|boost org|boost org license 1 0
unlicense|unlicense org|unlicense org
wtfpl|wtfpl net|wtfpl net
cc0-1|creativecommons|creativecommons org publicdomain zero 1 0
public-domain|creativecommons|creativecommons org publicdomain mark
cc-by-nc-nd|creativecommons|creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa|creativecommons|creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc|creativecommons|creativecommons org licenses by nc [1-4] [05]
cc-by-nd|creativecommons|creativecommons org licenses by nd [1-4] [05]
cc-by-sa|creativecommons|creativecommons org licenses by sa [1-4] [05]
cc-by|creativecommons|creativecommons org licenses by [1-4] [05]
odbl-1|opendatacommons|opendatacommons org licenses odbl
odc-by-1|opendatacommons|opendatacommons org licenses by
ofl-1.1|scripts sil|scripts sil org ofl
postgresql|postgresql org|postgresql org about licence
python-2|python org|docs python org 3 license
"""

# Which licences are announced by "licensed under (the) …" and "released under (the) …" notices.
_NOTICES = """
mit=mit(?: licen[cs]e)?, apache-2=apache(?: licen[cs]e)?(?: version)? v?2(?: 0)?, bsd=bsd(?: licen[cs]e)?, gpl=(?:gnu )?(?:gpl|general public licen[cs]e),
gpl-2=(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? v?2, gpl-3=(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? v?3,
lgpl=(?:gnu )?(?:lgpl|lesser general public licen[cs]e), agpl-3=(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)? v?3,
mpl-2=mozilla public licen[cs]e(?: version| v)? 2 0, isc=isc(?: licen[cs]e)?, cc0-1=cc0, unlicense=unlicense,
cc-by=(?:cc by|creative commons attribution)(?: [1-4] 0)?, cc-by-nc=(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?,
cc-by-sa=(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?, cc-by-nd=(?:cc by nd|creative commons attribution no ?derivatives)(?: [1-4] 0)?
"""


def _lines(block: str):
    return [line.split("|", 2) for line in block.strip().splitlines()]


def _pairs(block: str):
    for item in re.split(r",\s*|\s(?=[\w.-]+=)", block.strip()):
        if item:
            yield item.split("=", 1)


def _rules() -> tuple[Rule, ...]:
    raw = [(GRANT, *x) for x in _lines(_GRANTS)]
    for label, name in _pairs(_TAGS):
        raw.append((TAG, label, "spdx", f"spdx license identifier {name}"))
        raw.append((TAG, label, "license", f"license(?: expression)? {name}"))
    raw += [(LINK, *x) for x in _lines(_LINKS)]
    for label, name in _pairs(_NOTICES):
        raw.append((NOTICE, label, "licensed", f"licensed under (?:the |a |an )?{name}"))
        raw.append((NOTICE, label, "released", f"released under (?:the |a |an )?{name}"))
        raw.append((NOTICE, label, "distributed", f"distributed under (?:the |a |an )?{name}"))
        raw.append((NOTICE, label, "terms", f"(?:under|subject to) the terms of (?:the |a |an )?{name}"))
    raw += [(NAME, *x) for x in _lines(_NAMES)]
    return tuple(Rule(p, i, label, key, WEIGHT[p], re.compile(rf"(?<!\S){body}(?!\S)")) for i, (p, label, key, body) in enumerate(raw))


RULES = _rules()

# Phrases and labels of the base contract: fixed values.
BASE = {
    ("under", "the", "mit", "license"): "mit",
    ("apache", "license", "version", "2"): "apache-2",
    ("cc", "by", "nc"): "cc-by-nc",
}
