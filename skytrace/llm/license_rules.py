"""License signatures, written by hand: label, keyword and regular expression, by kind.

Expressions run over lower-cased words that single blanks join, so ``GPL-3.0`` reads ``gpl 3 0``. The keyword is a sequence
of whole words that every match of the rule holds.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signature:
    keyword: str
    pattern: str
    label: str
    priority: int
    score: float


#: Kinds, the first ones win: machine-readable tags, sentences of license texts, grants, names with a version, names alone.
KINDS = {"tag": (100, 1.0), "text": (90, 0.97), "grant": (80, 0.95), "version": (60, 0.85), "name": (50, 0.75)}

# Identifiers and wording of the licenses themselves, in alphabetical order of labels within a kind.
RULES = {
    "tag": r"""
0bsd | spdx license identifier | spdx license identifier 0bsd
afl-3.0 | spdx license identifier | spdx license identifier afl 3 0
agpl-3.0 | spdx license identifier | spdx license identifier agpl 3 0(?: only| or later)?
apache-1.1 | spdx license identifier | spdx license identifier apache 1 1
apache-2.0 | spdx license identifier | spdx license identifier apache 2 0(?: with llvm exception)?
artistic-2.0 | spdx license identifier | spdx license identifier artistic 2 0
bsd-2-clause | spdx license identifier | spdx license identifier bsd 2 clause(?: patent)?
bsd-3-clause | spdx license identifier | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | spdx license identifier | spdx license identifier bsd 4 clause(?: uc)?
bsl-1.0 | spdx license identifier | spdx license identifier bsl 1 0
cc-by-3.0 | spdx license identifier | spdx license identifier cc by 3 0
cc-by-4.0 | spdx license identifier | spdx license identifier cc by 4 0
cc-by-nc-4.0 | spdx license identifier | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | spdx license identifier | spdx license identifier cc by nc sa 4 0
cc-by-nd-4.0 | spdx license identifier | spdx license identifier cc by nd 4 0
cc-by-sa-3.0 | spdx license identifier | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | spdx license identifier | spdx license identifier cc by sa 4 0
cc0-1.0 | spdx license identifier | spdx license identifier cc0 1 0
cddl-1.0 | spdx license identifier | spdx license identifier cddl 1 0
cddl-1.1 | spdx license identifier | spdx license identifier cddl 1 1
cpl-1.0 | spdx license identifier | spdx license identifier cpl 1 0
epl-1.0 | spdx license identifier | spdx license identifier epl 1 0
epl-2.0 | spdx license identifier | spdx license identifier epl 2 0
eupl-1.2 | spdx license identifier | spdx license identifier eupl 1 2
gfdl-1.3 | spdx license identifier | spdx license identifier gfdl 1 3(?: only| or later| invariants| no invariants)*
gpl-2.0 | spdx license identifier | spdx license identifier gpl 2 0(?: only| or later)?(?: with classpath exception 2 0| with linux syscall note)?
gpl-3.0 | spdx license identifier | spdx license identifier gpl 3 0(?: only| or later)?
isc | spdx license identifier | spdx license identifier isc
lgpl-2.1 | spdx license identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx license identifier | spdx license identifier lgpl 3 0(?: only| or later)?
mit | spdx license identifier | spdx license identifier mit(?! 0 )
mit-0 | spdx license identifier | spdx license identifier mit 0
mpl-1.0 | spdx license identifier | spdx license identifier mpl 1 0
mpl-1.1 | spdx license identifier | spdx license identifier mpl 1 1
mpl-2.0 | spdx license identifier | spdx license identifier mpl 2 0(?: no copyleft exception)?
ms-pl | spdx license identifier | spdx license identifier ms pl
ofl-1.1 | spdx license identifier | spdx license identifier ofl 1 1
osl-3.0 | spdx license identifier | spdx license identifier osl 3 0
psf-2.0 | spdx license identifier | spdx license identifier (?:psf|python) 2 0
unlicense | spdx license identifier | spdx license identifier unlicense
wtfpl | spdx license identifier | spdx license identifier wtfpl
zlib | spdx license identifier | spdx license identifier zlib
apache-2.0 | classifier license osi approved | classifier license osi approved apache software license
bsd | classifier license osi approved | classifier license osi approved bsd license
gpl-3.0 | classifier license osi approved | classifier license osi approved gnu general public license v3(?: or later)?(?: gplv3)?
mit | classifier license osi approved | classifier license osi approved mit license
""",
    "text": r"""
afl | licensed under the academic free license | licensed under the academic free license version \d(?: \d)?
agpl | notwithstanding any other provision of this license | notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users interacting with it remotely
agpl | gnu affero general public license | under the terms of the gnu affero general public license as published by the free software foundation
apache-1.1 | the end user documentation included with the redistribution | the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment this product includes software developed by the apache software foundation
apache-2.0 | you may not use this file except in compliance | you may not use this file except in compliance with the license
apache-2.0 | you may obtain a copy of the license at | you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | software distributed under the license is distributed | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | specific language governing permissions and limitations | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | terms and conditions for use reproduction and distribution | terms and conditions for use reproduction and distribution 1 definitions
apache-2.0 | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
artistic | the artistic license preamble | the artistic license preamble the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | everyone is permitted to copy and distribute verbatim | copyright c 2000 2006 the perl foundation everyone is permitted to copy and distribute verbatim copies of this license document
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | this software is provided by | this software is provided by (?:the )?(?:copyright holders? and contributors|author and contributors|regents and contributors|author) as is and any express or implied warranties
bsd-3-clause | may be used to endorse or promote products | neither the names? of (?:[^ ]+ ){1,20}may be used to endorse or promote products derived from this software
bsd-3-clause | may not be used to endorse or promote products | the name of the author may not be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features or use | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsl-1.0 | to use reproduce display distribute execute and transmit the software | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software
bsl-1.0 | boost software license version 1 0 | distributed under the boost software license version 1 0
cc-by | licensed under a creative commons attribution | (?:this work is )?licensed under a creative commons attribution(?: international)? licen[cs]e
cc0 | waived all copyright and related or neighboring rights | has waived all copyright and related or neighboring rights to
cddl | the common development and distribution license | the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license
cpl | this common public license | the accompanying program is provided under the terms of this common public license agreement
epl | this eclipse public license | the accompanying program is provided under the terms of this eclipse public license agreement
epl | made available under the terms of the eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license
eupl | licensed under the eupl | licensed under the eupl(?: version)?(?: \d \d)?(?: or later| or as soon they will be approved)?
gfdl | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl | free software you can redistribute it and or modify | (?:this program|this file|this software|it|[^ ]+) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | see the gnu general public license for more details | see the gnu general public license for more details
gpl | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|file|software|library)
gpl | preamble the gnu general public license | preamble the gnu general public license is a free copyleft license for software and other kinds of works
gpl | guarantee your freedom to share and change | the gnu general public license is intended to guarantee your freedom to share and change
gpl-2.0 | either version 2 of the license | either version 2 of the license or at your option any later version
gpl-2.0 | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-2.0 | the free software foundation version 2 | under the terms of the gnu general public license(?: version 2)? as published by the free software foundation version 2
gpl-3.0 | either version 3 of the license | either version 3 of the license or at your option any later version
gpl-3.0 | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
isc | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | the author disclaims all warranties with regard | the software is provided as is and the author disclaims all warranties with regard to this software
lgpl | gnu lesser general public license | under the terms of the gnu lesser general public license(?: version \d(?: \d)?)? as published by the free software foundation
lgpl | gnu library general public license | under the terms of the gnu library general public license(?: version \d)? as published by the free software foundation
lgpl | you should have received a copy of the gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with this
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2.1 | either version 2 1 of the license | either version 2 1 of the license or at your option any later version
lppl | latex project public license | distributed and or modified under the conditions of the latex project public license
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | shall be included in all copies or substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | without warranty of any kind express or implied including but not limited | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | in no event shall the authors or copyright holders be liable | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mpl | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license
mpl-1.1 | subject to the mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | you can obtain one at | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
ms-pl | this license governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license
ncsa | with the software without restriction including without limitation | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
ofl | licensed under the sil open font license | this font software is licensed under the sil open font license
openssl | this product includes software developed by the openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
osl | licensed under the open software license | licensed under the open software license(?: version)? \d \d
php | this product includes php | this product includes php (?:software )?freely available from
postgresql | without a written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
proprietary | all rights reserved unauthorized copying | all rights reserved unauthorized copying of this file via any medium is strictly prohibited
proprietary | proprietary and confidential | (?:this (?:file|software|document) is )?proprietary and confidential
psf | this license agreement is between the python software foundation | this license agreement is between the python software foundation psf and the individual or organization
public-domain | into the public domain | (?:the authors? (?:has |have )?)?(?:hereby )?(?:placed|released|dedicated?s?|puts?) (?:this (?:code|file|software|work|program) |it )?(?:in|into|to) into the public domain
public-domain | in the public domain | this (?:code|file|software|work|program) is (?:placed )?in the public domain
sleepycat | information on how to obtain complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
unlicense | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell | anyone is free to copy modify publish use compile sell or distribute this software
w3c | w3c software notice and license | w3c software notice and license
wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented
zlib | without any express or implied warranty | this software is provided as is without any express or implied warranty
zpl | zope public license | this software is subject to the provisions of the zope public license
""",
    "grant": r"""
agpl | affero | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero (?:general public license|gpl)
agpl-3.0 | agplv3 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agplv3
apache | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: license)?(?! (?:license|version|v|2|v2))
apache-2.0 | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: license)?(?: version| v)? (?:2 0|v2 0|2|v2)
apache-1.1 | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache software license(?: version)? 1 1
artistic | artistic license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:perl )?artistic license
bsd | bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the |a )?)?(?:modified |simplified |new |revised )?bsd(?: style)?(?: licen[cs]e)?
bsd-2-clause | bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the |a )?)?(?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-3-clause | bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the |a )?)?(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsl-1.0 | boost software license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?boost software license
cc-by | cc by | (?:licensed|released|distributed|available|published|provided|shared) under (?:the |a )?cc by(?! (?:nc|nd|sa|\d))
cc-by-4.0 | cc by 4 0 | (?:licensed|released|distributed|available|published|provided|shared) under (?:the |a )?cc by 4 0
cc-by-sa-4.0 | cc by sa 4 0 | (?:licensed|released|distributed|available|published|provided|shared) under (?:the |a )?cc by sa 4 0
cc-by-nc-4.0 | cc by nc 4 0 | (?:licensed|released|distributed|available|published|provided|shared) under (?:the |a )?cc by nc 4 0
cc0 | cc0 | (?:licensed|released|distributed|available|published|provided|dedicated) (?:under|as|with) (?:the )?cc0
cddl | cddl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?cddl
epl | eclipse public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?eclipse public license
eupl | european union public | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?european union public licen[cs]e
gfdl | free documentation license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?free documentation license
gpl | gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl | general public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public license
gpl-2.0 | gplv2 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gplv2
gpl-3.0 | gplv3 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gplv3
isc | isc | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?isc(?: licen[cs]e)?
lgpl | lgpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl
lgpl | lesser general public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public license
mit | mit | (?:licensed|released|distributed|available|published|provided) under (?:the |an )?(?:terms of (?:the )?)?mit(?: x11| expat)?(?: style)? licen[cs]e
mpl | mozilla public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mozilla public license
ofl | open font license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:sil )?open font license
perl | same terms as perl | (?:redistribute|distribute|modify|licensed)(?: it)?(?: and or modify it)? under the same terms as perl(?: itself| 5)?
public-domain | public domain | (?:released|placed|dedicated|available) (?:in|into|to) the public domain
unlicense | unlicense | (?:licensed|released|distributed|available|published|provided) under (?:the )?unlicense
zlib | zlib | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)?(?: licen[cs]e)?
""",
    "version": r"""
afl-2.1 | academic free license | academic free license(?: version| v)? (?:v)?2 1
afl-3.0 | academic free license | academic free license(?: version| v)? (?:v)?3 0
agpl-1.0 | affero general public license | affero general public license(?: version| v)? (?:v)?1(?: 0)?
agpl-3.0 | affero general public license | (?:gnu )?affero general public license(?: version| v)? (?:v3|3)(?: 0)?
agpl-3.0 | agpl | (?:gnu )?agpl (?:v3|version 3|3 0)(?: 0)?
agpl-3.0 | agplv3 | (?:gnu )?agplv3(?: or later)?
apache-1.0 | apache | apache(?: software)? license(?: version| v)? (?:v)?1 0
apache-1.1 | apache | apache(?: software)? license(?: version| v)? (?:v)?1 1
apache-2.0 | apache | apache(?: software)? license(?: version| v)? (?:2 0|v2 0|v2)
apache-2.0 | apache 2 0 | apache 2 0(?: licen[cs]e)?
apache-2.0 | asl 2 0 | asl 2 0
artistic-1.0 | artistic license | artistic license(?: version| v)? 1 0
artistic-2.0 | artistic license | artistic license(?: version| v)? (?:2 0|v2)
0bsd | zero clause bsd | (?:bsd )?zero clause bsd(?: licen[cs]e)?
bsd-2-clause | 2 clause | (?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd-2-clause | simplified bsd license | simplified bsd license
bsd-2-clause | freebsd license | freebsd license
bsd-3-clause | 3 clause | (?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-3-clause | new bsd license | new bsd license
bsd-3-clause | modified bsd license | modified bsd license
bsd-3-clause | revised bsd license | revised bsd license
bsd-4-clause | 4 clause | (?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?
bsd-4-clause | original bsd license | original bsd license
bsl-1.0 | boost software license | boost software license(?: version| v)? 1 0
bsl-1.1 | business source license | business source license(?: version| v)? 1 1
cc-by-2.0 | creative commons attribution 2 0 | creative commons attribution 2 0(?: generic| unported)?(?: licen[cs]e)?
cc-by-3.0 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-4.0 | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by-nc-3.0 | creative commons attribution | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nc-4.0 | creative commons attribution | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-sa-3.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nd-4.0 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0
cc-by-sa-2.0 | creative commons attribution | creative commons attribution share ?alike 2 [05](?: generic)?
cc-by-sa-3.0 | creative commons attribution | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
cc0-1.0 | cc0 1 0 | (?:creative commons )?cc0 1 0(?: universal)?
cddl-1.0 | common development and distribution license | common development and distribution license(?: cddl)?(?: version| v)? (?:v)?1 0
cddl-1.0 | cddl | cddl(?: version| v)? (?:v)?1 0
cddl-1.1 | common development and distribution license | common development and distribution license(?: cddl)?(?: version| v)? (?:v)?1 1
cddl-1.1 | cddl | cddl(?: version| v)? (?:v)?1 1
cecill-2.1 | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? (?:v)?2 1
cpl-1.0 | common public license | common public license(?: version| v)? (?:v)?1 0
edl-1.0 | eclipse distribution license | eclipse distribution license(?: version| v)? (?:v)?1 0
epl-1.0 | eclipse public license | eclipse public license(?: version| v)? (?:v1|1)(?: 0)?
epl-2.0 | eclipse public license | eclipse public license(?: version| v)? (?:v2|2)(?: 0)?
eupl-1.1 | european union public | european union public licen[cs]e(?: version| v)? (?:v)?1 1
eupl-1.2 | european union public | european union public licen[cs]e(?: version| v)? (?:v)?1 2
gfdl-1.1 | free documentation license | (?:gnu )?free documentation license(?: version| v)? (?:v)?1 1
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license(?: version| v)? (?:v)?1 2
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license(?: version| v)? (?:v)?1 3
gpl-1.0 | general public license | (?:gnu )?general public license(?: version| v)? (?:v1|1 0)
gpl-2.0 | general public license | (?:gnu )?general public license (?:v2|version 2|v 2|2 0)(?: 0)?(?: only| or later)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2(?: or later)?
gpl-2.0 | gpl | (?:gnu )?gpl (?:v2|version 2|2 0)(?: 0)?(?: only| or later)?
gpl-3.0 | general public license | (?:gnu )?general public license (?:v3|version 3|v 3|3 0)(?: 0)?(?: only| or later)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3(?: or later)?
gpl-3.0 | gpl | (?:gnu )?gpl (?:v3|version 3|3 0)(?: 0)?(?: only| or later)?
lgpl-2.0 | library general public license | (?:gnu )?library general public license(?: version| v)? (?:v2|2)(?: 0)?
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license(?: version| v)? (?:v)?2 1
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version| v)? (?:v)?2 1(?: or later)?
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:v3|version 3|3 0)(?: 0)?
lgpl-3.0 | lgpl | (?:gnu )?lgpl (?:v3|version 3|3 0)(?: 0)?
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3(?: or later)?
lppl-1.3c | latex project public license | latex project public license(?: version| v)? 1 3c?
mit-0 | mit no attribution | mit no attribution
mpl-1.0 | mozilla public license | mozilla public license(?: version| v)? (?:v)?1 0
mpl-1.1 | mozilla public license | mozilla public license(?: version| v)? (?:v)?1 1
mpl-1.1 | mpl 1 1 | mpl 1 1
mpl-2.0 | mozilla public license | mozilla public license(?: version| v)? (?:v)?2 0
mpl-2.0 | mpl 2 0 | mpl 2 0
ofl-1.0 | open font license | (?:sil )?open font license(?: version| v)? (?:v)?1 0
ofl-1.1 | open font license | (?:sil )?open font license(?: version| v)? (?:v)?1 1
osl-2.1 | open software license | open software license(?: version| v)? (?:v)?2 1
osl-3.0 | open software license | open software license(?: version| v)? (?:v)?3 0
psf-2.0 | python software foundation license | python software foundation license(?: version| v)? 2
sspl-1.0 | server side public license | server side public license(?: version| v)? (?:v1|1)(?: 0)?
zpl-2.1 | zope public license | zope public license(?: version| v)? 2 1
""",
    "name": r"""
agpl | affero general public license | (?:gnu )?affero general public license
artistic | artistic license | artistic license
bsd | bsd license | bsd license
bsl-1.0 | boost software license | boost software license
cddl | common development and distribution license | common development and distribution license
cecill | cecill license | cecill license
cpl | common public license | common public license
epl | eclipse public license | eclipse public license
eupl | european union public | european union public licen[cs]e
gfdl | free documentation license | (?:gnu )?free documentation license
gpl | gnu gpl | gnu gpl
isc | isc license | (?:the )?isc license
lgpl | lesser general public license | (?:gnu )?lesser general public license
lgpl | gnu lgpl | gnu lgpl
lppl | latex project public license | latex project public license
mit | mit license | (?:the )?mit license
mit | x11 license | (?:mit )?x11 license
mit | expat license | expat license
mpl | mozilla public license | mozilla public license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
ncsa | open source license | university of illinois (?:ncsa )?open source license
odbl | open database license | (?:open data commons )?open database license
ofl | open font license | (?:sil )?open font license
osl | open software license | open software license
php | php license | php license
postgresql | postgresql license | postgresql license
psf | python software foundation license | python software foundation license
unlicense | the unlicense | the unlicense
vim | vim license | vim license
wtfpl | wtfpl | wtfpl
zlib | zlib license | zlib license
zlib | zlib libpng license | zlib libpng license
zpl | zope public license | zope public license
""",
}


def signatures() -> list[Signature]:
    """All rules in order: kinds from the first on, and within a kind as listed."""
    out = []
    for kind, lines in RULES.items():
        for line in lines.strip().split("\n"):
            label, keyword, pattern = line.split(" | ")
            out.append(Signature(keyword, pattern, label, *KINDS[kind]))
    return out
