"""Signature rules for licence notices, written by hand.

Each line of NAMED is `label | identifier | name | address`: the identifier as it
stands after an SPDX tag, the ways the name is written in a notice, and the
address of the text; a dash leaves one out. Each line of WORDED is
`label | keyword | pattern`, for sentences of the texts themselves. Patterns are
regular expressions over lower-case text; a blank stands for any white space.
"""

from __future__ import annotations

import re
from typing import NamedTuple

NAMED = r"""
apache-2.0 | apache-2\.0 | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)? | apache\.org/licenses/license-2\.0
apache-1.1 | apache-1\.1 | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1 | apache\.org/licenses/license-1\.1
apache-1.0 | apache-1\.0 | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.0 | apache\.org/licenses/license-1\.0
mit | mit | (?:the )?mit licen[sc]e | opensource\.org/licenses?/mit
mit-0 | mit-0 | mit no attribution(?: licen[sc]e)? | opensource\.org/licenses?/mit-0
expat | - | expat licen[sc]e | -
x11 | x11 | x11 licen[sc]e | -
isc | isc | isc licen[sc]e | opensource\.org/licenses?/isc
0bsd | 0bsd | zero[- ]clause bsd(?: licen[sc]e)? | opensource\.org/licenses?/0bsd
bsd-2-clause | bsd-2-clause | (?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd(?: licen[sc]e)? | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd-3-clause | (?:new|modified|revised|3[- ]clause|three[- ]clause) bsd(?: licen[sc]e)? | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd-4-clause | (?:original|4[- ]clause|four[- ]clause) bsd(?: licen[sc]e)? | -
bsd | - | bsd(?:[- ]style)? licen[sc]e | -
gpl-1.0 | gpl-1\.0(?:-only|-or-later|\+)? | gnu general public licen[sc]e,? (?:version |v\.? ?)1(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
gpl-2.0 | gpl-2\.0(?:-only|-or-later|\+)? | gnu general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | gpl-3\.0(?:-only|-or-later|\+)? | gnu general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)? | gnu\.org/licenses/gpl-3\.0
gpl | gpl | gnu gpl | gnu\.org/(?:licenses|copyleft)/gpl\.(?:html|txt)
lgpl-2.0 | lgpl-2\.0(?:-only|-or-later|\+)? | gnu library general public licen[sc]e | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later|\+)? | gnu lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later|\+)? | gnu lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)? | gnu\.org/licenses/lgpl-3\.0
lgpl | lgpl | gnu lesser general public licen[sc]e | gnu\.org/(?:licenses|copyleft)/lgpl\.(?:html|txt)
agpl-3.0 | agpl-3\.0(?:-only|-or-later|\+)? | gnu affero general public licen[sc]e(?:,? (?:version |v\.? ?)3(?:\.0)?)? | gnu\.org/licenses/agpl-3\.0
fdl-1.2 | gfdl-1\.2(?:-only|-or-later)? | gnu free documentation licen[sc]e,? (?:version |v\.? ?)1\.2 | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
fdl-1.3 | gfdl-1\.3(?:-only|-or-later)? | gnu free documentation licen[sc]e,? (?:version |v\.? ?)1\.3 | gnu\.org/licenses/fdl-1\.3
fdl | gfdl | gnu free documentation licen[sc]e | gnu\.org/(?:licenses|copyleft)/fdl\.(?:html|txt)
mpl-1.0 | mpl-1\.0 | mozilla public licen[sc]e,? (?:version |v\.? ?)1\.0 | mozilla\.org/mpl/1\.0
mpl-1.1 | mpl-1\.1 | mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mpl-2\.0 | mozilla public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)? | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl | - | mozilla public licen[sc]e | mozilla\.org/mpl/?
epl-1.0 | epl-1\.0 | eclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)?1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | epl-2\.0 | eclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)?2\.0 | eclipse\.org/legal/epl-(?:v20|2\.0)
edl-1.0 | - | eclipse distribution licen[sc]e | eclipse\.org/org/documents/edl-v10
cpl-1.0 | cpl-1\.0 | common public licen[sc]e | -
ipl-1.0 | ipl-1\.0 | ibm public licen[sc]e | -
cddl-1.0 | cddl-1\.0 | common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)1\.0)? | opensource\.org/licenses?/cddl-1\.0
cddl-1.1 | cddl-1\.1 | common development and distribution licen[sc]e,? (?:version |v\.? ?)1\.1 | -
eupl-1.1 | eupl-1\.1 | european union public licen[sc]e,? (?:version |v\.? ?)?1\.1 | -
eupl-1.2 | eupl-1\.2 | european union public licen[sc]e(?:,? (?:version |v\.? ?)?1\.2)? | joinup\.ec\.europa\.eu/[a-z/]*eupl
cc0-1.0 | cc0-1\.0 | cc0(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm | - | creative commons public domain mark | creativecommons\.org/publicdomain/mark/1\.0
cc-by-1.0 | cc-by-1\.0 | cc[- ]by[- ]1\.0 | creativecommons\.org/licenses/by/1\.0
cc-by-2.0 | cc-by-2\.0 | cc[- ]by[- ]2\.0 | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | cc-by-2\.5 | cc[- ]by[- ]2\.5 | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | cc-by-3\.0 | cc[- ]by[- ]3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | cc-by-4\.0 | cc[- ]by[- ]4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by | - | creative commons attribution(?: licen[sc]e)? | creativecommons\.org/licenses/by/
cc-by-sa-2.0 | cc-by-sa-2\.0 | cc[- ]by[- ]sa[- ]2\.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-3.0 | cc-by-sa-3\.0 | cc[- ]by[- ]sa[- ]3\.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | cc-by-sa-4\.0 | cc[- ]by[- ]sa[- ]4\.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa | - | (?:cc[- ]by[- ]sa|creative commons attribution[- ]share[- ]?alike) | creativecommons\.org/licenses/by-sa/
cc-by-nd-3.0 | cc-by-nd-3\.0 | cc[- ]by[- ]nd[- ]3\.0 | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 | cc-by-nd-4\.0 | cc[- ]by[- ]nd[- ]4\.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd | - | (?:cc[- ]by[- ]nd|creative commons attribution[- ]no[- ]?deriv[a-z]*) | creativecommons\.org/licenses/by-nd/
cc-by-nc-2.0 | cc-by-nc-2\.0 | cc[- ]by[- ]nc[- ]2\.0 | creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-3.0 | cc-by-nc-3\.0 | cc[- ]by[- ]nc[- ]3\.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | cc-by-nc-4\.0 | cc[- ]by[- ]nc[- ]4\.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc | - | (?:cc[- ]by[- ]nc|creative commons attribution[- ]non[- ]?commercial) | creativecommons\.org/licenses/by-nc/
cc-by-nc-sa-3.0 | cc-by-nc-sa-3\.0 | cc[- ]by[- ]nc[- ]sa[- ]3\.0 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 | cc-by-nc-sa-4\.0 | cc[- ]by[- ]nc[- ]sa[- ]4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa | - | (?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike) | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd-3.0 | cc-by-nc-nd-3\.0 | cc[- ]by[- ]nc[- ]nd[- ]3\.0 | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 | cc-by-nc-nd-4\.0 | cc[- ]by[- ]nc[- ]nd[- ]4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd | - | (?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv[a-z]*) | creativecommons\.org/licenses/by-nc-nd/
odbl-1.0 | odbl-1\.0 | (?:odc )?open database licen[sc]e | opendatacommons\.org/licenses/odbl
odc-by-1.0 | odc-by-1\.0 | open data commons attribution licen[sc]e | opendatacommons\.org/licenses/by
pddl-1.0 | pddl-1\.0 | public domain dedication and licen[sc]e | opendatacommons\.org/licenses/pddl
ogl-3.0 | ogl-uk-3\.0 | open government licen[sc]e | nationalarchives\.gov\.uk/doc/open-government-licence
unlicense | unlicense | (?:the )?unlicense | unlicense\.org
wtfpl | wtfpl | do what the f[a-z*]+ you want to public licen[sc]e | wtfpl\.net
zlib | zlib | zlib(?:/libpng)? licen[sc]e | opensource\.org/licenses?/zlib
libpng | libpng(?:-2\.0)? | libpng licen[sc]e | -
bsl-1.0 | bsl-1\.0 | boost software licen[sc]e | boost\.org/license_1_0\.txt
busl-1.1 | busl-1\.1 | business source licen[sc]e | mariadb\.com/bsl11
sspl-1.0 | sspl-1\.0 | server side public licen[sc]e | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic-2\.0 | elastic licen[sc]e | elastic\.co/licensing/elastic-license
artistic-1.0 | artistic-1\.0(?:-perl)? | artistic licen[sc]e,? (?:version |v\.? ?)?1\.0 | -
artistic-2.0 | artistic-2\.0 | artistic licen[sc]e,? (?:version |v\.? ?)?2\.0 | perlfoundation\.org/artistic_license_2_0
artistic | - | artistic licen[sc]e | -
python-2.0 | python-2\.0 | (?:python software foundation|psf) licen[sc]e | docs\.python\.org/3/license
php-3.01 | php-3\.01 | php licen[sc]e | php\.net/license
ruby | ruby | ruby licen[sc]e | -
postgresql | postgresql | postgresql licen[sc]e | postgresql\.org/about/licence
openssl | openssl | openssl licen[sc]e | openssl\.org/source/license
ofl-1.1 | ofl-1\.1(?:-rfn|-no-rfn)? | sil open font licen[sc]e | scripts\.sil\.org/ofl
lppl-1.3c | lppl-1\.3c | latex project public licen[sc]e | latex-project\.org/lppl
ms-pl | ms-pl | microsoft public licen[sc]e | opensource\.org/licenses?/ms-pl
ms-rl | ms-rl | microsoft reciprocal licen[sc]e | opensource\.org/licenses?/ms-rl
afl-3.0 | afl-3\.0 | academic free licen[sc]e | opensource\.org/licenses?/afl-3\.0
osl-3.0 | osl-3\.0 | open software licen[sc]e | opensource\.org/licenses?/osl-3\.0
upl-1.0 | upl-1\.0 | universal permissive licen[sc]e | -
ncsa | ncsa | university of illinois/ncsa open source licen[sc]e | opensource\.org/licenses?/ncsa
ecl-2.0 | ecl-2\.0 | educational community licen[sc]e | -
vim | vim | vim licen[sc]e | -
blueoak-1.0.0 | blueoak-1\.0\.0 | blue oak model licen[sc]e | blueoakcouncil\.org/license
openrail | - | (?:bigscience |creativeml )?open ?rail(?:[- ]?\+?\+?m)?(?: licen[sc]e)? | -
llama-community | - | llama \d(?:\.\d)? community licen[sc]e | -
cecill-2.1 | cecill-2\.1 | cecill(?: free software)? licen[sc]e | cecill\.info/licences
mulanpsl-2.0 | mulanpsl-2\.0 | mulan psl | license\.coscl\.org\.cn/mulanpsl2
"""

WORDED = r"""
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software
isc | permission to use | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
gpl | redistribute it and/or modify | redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
lgpl | redistribute it and/or modify | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
agpl-3.0 | redistribute it and/or modify | redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e
gpl | fitness for a particular | without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public
apache-2.0 | except in compliance | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | without warranties or conditions | without warranties or conditions of any kind, either express or implied
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public licen[sc]e
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
public-domain | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
cc0-1.0 | waived all copyright | waived all copyright and related or neighboring rights
zlib | altered source versions | altered source versions must be plainly marked as such
bsl-1.0 | machine-executable object code | in the form of machine-executable object code generated by a source language processor
artistic | same terms as perl | under the same terms as perl itself
proprietary | all rights reserved | copyright[^\n]{0,60}all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
proprietary | may not be reproduced | may not be reproduced[^\n]{0,80}without (?:the )?(?:prior )?(?:written )?permission
no-warranty | provided "as is" | the software is provided "as is", without warranty of any kind
gpl | gpl | (?<![a-z])gpl ?v? ?[123](?:\.0)?\+?(?![0-9a-z.])
lgpl | lgpl | (?<![a-z])lgpl ?v? ?[23](?:\.[01])?\+?(?![0-9a-z.])
agpl-3.0 | agpl | (?<![a-z])agpl ?v? ?3(?:\.0)?\+?(?![0-9a-z.])
cc-by | creative commons | creative commons attribution \d\.\d
cc-by-sa | wikipedia | text (?:of|from) wikipedia[^\n]{0,60}share[- ]?alike
dual-mit-gpl | dual | dual[- ]licensed under (?:the )?mit (?:and|or) (?:the )?gpl
dual-mit-apache | mit | mit/apache-2\.0|mit or apache-2\.0|apache-2\.0 or mit
"""


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str
    pattern: re.Pattern
    priority: int
    score: float


#: Of overlapping detections the kind with the higher priority stands; the score says how sure it is.
KINDS = {"tag": (4, 1.0), "worded": (3, 0.95), "notice": (3, 0.95), "address": (2, 0.9), "name": (1, 0.7)}


def _keyword(pattern: str) -> str:
    """The longest plain run that every match must hold, of letters, digits, dots, dashes and slashes."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\][*+?]?|.\?|\\d|\\(?=[^.])", "\0", pattern)
    plain = plain.replace("\\.", ".")
    return max(re.findall(r"[a-z0-9./_-]+", plain), key=len, default="")


def _ways(pattern: str) -> list[str]:
    """The alternatives of a pattern that is one group, each a rule of its own with its own keyword."""
    return pattern[3:-1].split("|") if re.fullmatch(r"\(\?:[^()]*\|creative commons [^|]*\)", pattern) else [pattern]


def _rule(label: str, kind: str, keyword: str, pattern: str) -> Rule:
    return Rule(label, kind, keyword, re.compile(pattern.replace(" ", r"\s+")), *KINDS[kind])


def rules() -> list[Rule]:
    """All rules, in the order of the tables."""
    found = []
    edge, end = r"(?<![0-9a-z])", r"(?![0-9a-z])"
    for line in NAMED.strip().splitlines():
        label, tag, name, address = (x.strip() for x in line.split(" | "))
        if tag != "-":
            found.append(_rule(label, "tag", "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?(?:[a-z0-9.+-]+\s+(?:or|and|with)\s+)*{tag}(?![0-9a-z.+-])"))
        for name in _ways(name) if name != "-" else []:
            found.append(_rule(label, "notice", _keyword(name), rf"licen[sc]ed under (?:the terms of )?(?:the )?(?:{name}){end}|(?:released|distributed|available) under (?:the terms of )?(?:the )?(?:{name}){end}"))
            found.append(_rule(label, "name", _keyword(name), rf"{edge}(?:{name}){end}"))
        if address != "-":
            found.append(_rule(label, "address", _keyword(address), address))
    for line in WORDED.strip().splitlines():
        label, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
        found.append(_rule(label, "worded", keyword.split(" ")[0] if " " in keyword else keyword, pattern))
    return found
