"""Hand-written license signatures: ``label | keyword | pattern``, best evidence first.

Patterns are matched on a text's words, lower-cased and joined by single blanks, from word
border to word border; a rule is tried only if the text holds its keyword. Rules of an
earlier section win over later ones that match inside their span; within a section the
earlier rule wins a tie.
"""

# Section 0: sentences of license texts. 1: grants and identifiers with a version.
# 2: names of licenses. 3: hints that something is licensed.
RULES = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | above copyright notice | the above copyright notice and this permission notice shall be included in all copies
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted (?:\w+ ){0,3}the software is provided
bsd-2-clause | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse or promote | neither the names? of (?:\w+ ){1,12}may be used to endorse or promote
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
warranty-disclaimer | without warranty | provided as is without warranty of any kind
warranty-disclaimer | merchantability | (?:the )?implied warranties of merchantability and fitness for a particular purpose
warranty-disclaimer | in no event shall | in no event shall (?:\w+ ){1,10}be liable for any
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | you may not use this file | you may not use this file except in compliance with the license
apache-2.0 | apache org licenses | (?:http |https |www )*apache org licenses license 2 0
gpl | free software you can redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-or-later | any later version | either version [123](?: 0)? of the license or at your option any later version
lgpl | free software you can redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
gpl | useful but without any warranty | in the hope that it will be useful but without any warranty
gpl | received a copy | you should have received a copy of the gnu general public license
lgpl | received a copy | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | received a copy | you should have received a copy of the gnu affero general public license
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license | subject to the mozilla public license version 1 1
epl-1.0 | eclipse public license | made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license | made available under the terms of the eclipse public license (?:v )?2 0
cddl-1.0 | common development and distribution | subject to the terms of the common development and distribution license
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | anyone is free | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | waived all copyright | (?:has |have )?waived all copyright and related or neighbou?ring rights
wtfpl | what the fuck | do what the fuck you want to(?: public license)?
zlib | misrepresented | the origin of this software must not be misrepresented
zlib | altered source versions | altered source versions must be plainly marked as such
boost-1.0 | boost software license | distributed under the boost software license version 1 0
artistic-2.0 | artistic license | under the terms of the artistic license(?: version)? 2 0
ofl-1.1 | open font license | this font software is licensed under the sil open font license version 1 1
python-2.0 | python software foundation | python software foundation license version 2
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ms-pl | license governs use | this license governs use of the accompanying software
proprietary | confidential | this (?:document|file|software|work) (?:is|contains) (?:strictly )?(?:proprietary and )?confidential
proprietary | may be reproduced | no part of this (?:book|publication|document|work|article) may be reproduced
proprietary | written permission | without (?:the )?(?:express(?:ed)? |prior )+written permission
proprietary | unauthori | unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: or (?:copying|reproduction|distribution|use))* (?:of this \w+ )?is (?:strictly )?prohibited
personal-use | commercial use only | for (?:your )?personal(?: and)?(?: or)? non commercial use only
educational-use | educational | for educational purposes only
crown | public sector information | contains public sector information licensed under the open government licence
--
apache-2.0 | apache license | (?:licensed|released|distributed|available|published) under (?:the )?apache license(?: version)? 2(?: 0)?
apache-2.0 | apache license | apache license(?: version)? (?:v)?2(?: 0)?
apache-2.0 | apache 2 0 | apache 2 0
apache-2.0 | apache2 | apache2
apache-1.1 | apache | apache(?: software)?(?: license)?(?: version)? 1 1
apache-1.0 | apache | apache(?: software)?(?: license)?(?: version)? 1 0
mit | mit license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit license
mit | spdx license identifier | spdx license identifier mit
apache-2.0 | spdx license identifier | spdx license identifier apache 2 0
gpl-2.0 | spdx license identifier | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | spdx license identifier | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.1 | spdx license identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx license identifier | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | spdx license identifier | spdx license identifier agpl 3 0(?: only| or later)?
bsd-2-clause | spdx license identifier | spdx license identifier bsd 2 clause
bsd-3-clause | spdx license identifier | spdx license identifier bsd 3 clause
mpl-2.0 | spdx license identifier | spdx license identifier mpl 2 0
isc | spdx license identifier | spdx license identifier isc
cc0-1.0 | spdx license identifier | spdx license identifier cc0 1 0
unlicense | spdx license identifier | spdx license identifier unlicense
epl-2.0 | spdx license identifier | spdx license identifier epl 2 0
spdx | spdx license identifier | spdx license identifier \w+
gpl-1.0 | general public license | (?:gnu )?general public license(?: gpl)? (?:version |v )?1(?: 0)?
gpl-2.0 | general public license | (?:gnu )?general public license(?: gpl)? (?:version |v )?2(?: 0)?
gpl-2.0 | general public license | (?:gnu )?general public license(?: gpl)? v2
gpl-3.0 | general public license | (?:gnu )?general public license(?: gpl)? (?:version |v )?3(?: 0)?
gpl-3.0 | general public license | (?:gnu )?general public license(?: gpl)? v3
lgpl-2.0 | library general public license | (?:gnu )?library general public license (?:version |v )?2(?: 0)?
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )?2 1
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )?3(?: 0)?
agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
gfdl-1.1 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 1
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 2
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 3
gpl-2.0 | gpl | gpl ?v?2(?: 0)?(?: only| or later)?
gpl-3.0 | gpl | gpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1 | lgpl | lgpl ?v?2 1(?: only| or later)?
lgpl-3.0 | lgpl | lgpl ?v?3(?: 0)?(?: only| or later)?
agpl-3.0 | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2 0
mpl-2.0 | mpl 2 0 | mpl 2 0
epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2 0
eupl-1.1 | european union public | european union public licen[cs]e (?:version |v )?1 1
eupl-1.2 | european union public | european union public licen[cs]e (?:version |v )?1 2
cc-by-1.0 | cc by | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-1.0 | cc by sa | cc by sa 1 0
cc-by-sa-2.0 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-nc-1.0 | cc by nc | cc by nc 1 0
cc-by-nc-2.0 | cc by nc | cc by nc 2 0
cc-by-nc-2.5 | cc by nc | cc by nc 2 5
cc-by-nc-3.0 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | cc by nc | cc by nc 4 0
cc-by-nd-2.0 | cc by nd | cc by nd 2 0
cc-by-nd-3.0 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | cc by nd | cc by nd 4 0
cc-by-nc-sa-2.0 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-2.5 | cc by nc sa | cc by nc sa 2 5
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-2.0 | cc by nc nd | cc by nc nd 2 0
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?
cc-by-2.0 | creative commons | creative commons attribution 2 0
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-3.0 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
cc0-1.0 | creativecommons org | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org | creativecommons org publicdomain mark 1 0
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
odbl-1.0 | open database license | open database license(?: odbl)?(?: v?1 0)?
odc-by-1.0 | open data commons | open data commons attribution license(?: v?1 0)?
pddl-1.0 | public domain dedication | (?:odc )?public domain dedication and licen[cs]e
ogl-3.0 | open government | open government licen[cs]e (?:version |v )?3(?: 0)?
ogl-2.0 | open government | open government licen[cs]e (?:version |v )?2(?: 0)?
cecill-2.1 | cecill | cecill (?:version |v )?2 1
cecill-b | cecill b | cecill b
cecill-c | cecill c | cecill c
artistic-1.0 | artistic license | artistic license(?: version)? 1 0
artistic-2.0 | artistic license | artistic license(?: version)? 2 0
afl-3.0 | academic free license | academic free license(?: version| v)? 3 0
osl-3.0 | open software license | open software license(?: version| v)? 3 0
boost-1.0 | boost software license | boost software license(?: version)? 1 0
llama-2 | llama 2 | llama 2 community license
llama-3 | llama 3 | llama 3 community license
openrail-m | openrail | (?:creativeml )?(?:bigscience )?openrailm?
--
mit | mit license | (?:the )?(?:terms of the )?mit license
mit | expat license | expat license
mit | x11 license | (?:mit )?x11 license
mit | massachusetts | massachusetts institute of technology license
apache | apache | (?:the )?apache(?: software)? licen[cs]e
bsd-2-clause | simplified bsd | simplified bsd license
bsd-2-clause | bsd 2 clause | bsd 2 clause
bsd-2-clause | 2 clause bsd | 2 clause bsd
bsd-3-clause | bsd 3 clause | bsd 3 clause
bsd-3-clause | 3 clause bsd | 3 clause bsd
bsd-3-clause | bsd license | (?:new|revised) bsd license
bsd-3-clause | modified bsd | modified bsd license
bsd-4-clause | original bsd | original bsd license
bsd | bsd | bsd(?: style)? licen[cs]ed?
bsd | bsd style licen | bsd style license
gpl | gnu gpl | gnu gpl
gpl | gpl licen | gpl licen[cs]ed?
lgpl | lesser general public | (?:gnu )?lesser general public licen[cs]e
lgpl | library general public | (?:gnu )?library general public licen[cs]e
lgpl | gnu lgpl | gnu lgpl
agpl | affero general public | (?:gnu )?affero general public licen[cs]e
agpl | affero gpl | affero gpl
gfdl | free documentation | (?:gnu )?free documentation licen[cs]e
gfdl | gfdl | gfdl
mpl | mozilla public | mozilla public licen[cs]e
epl | eclipse public | eclipse public licen[cs]e
cddl | common development and distribution | common development and distribution licen[cs]e
cpl | common public license | common public license
ipl | ibm public license | ibm public license
isc | isc license | isc license
zlib | zlib | zlib(?: libpng)? license
boost | boost software | boost software licen[cs]e
artistic | artistic licen | (?:perl )?artistic licen[cs]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
ofl | open font | (?:sil )?open font licen[cs]e
eupl | european union public | european union public licen[cs]e
eupl | eupl | eupl
cecill | cecill | cecill
ms-pl | microsoft public | microsoft public licen[cs]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
psf | python software foundation | python software foundation licen[cs]e
php | php licen | php licen[cs]e
ruby | ruby licen | ruby licen[cs]e
vim | vim licen | vim licen[cs]e
openssl | openssl licen | openssl licen[cs]e
postgresql | postgresql licen | postgresql licen[cs]e
qpl | q public licen | q public licen[cs]e
sleepycat | sleepycat | sleepycat licen[cs]e
bsl | business source | business source licen[cs]e
sspl | server side public | server side public licen[cs]e
elastic | elastic licen | elastic licen[cs]e
commons-clause | commons clause | commons clause
beerware | beerware | beerware(?: license)?
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
upl | universal permissive | universal permissive licen[cs]e
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
cc-by | creative commons | creative commons attribution(?: licen[cs]e)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)?
cc0 | creative commons | creative commons zero
odbl | odbl | odbl
ogl | open government | open government licen[cs]e
public-domain | public domain | (?:released |dedicated |placed )?(?:in|into|to) the public domain
public-domain | public domain | public domain(?: dedication| mark| work)?
proprietary | proprietary | proprietary licen[cs]e
commercial | commercial licen | commercial licen[cs]e
eula | end user licen | end user licen[cs]e agreement
--
creative-commons | creative commons | creative commons(?: licen[cs]e)?
creative-commons | creativecommons org | creativecommons org
licensed | licensed under | licensed under(?: the)?(?: terms of)?(?: the)?
licensed | licen | released under (?:the |a |an )?(?:\w+ ){0,3}licen[cs]e
licensed | licen | distributed under (?:the |a |an )?(?:\w+ ){0,3}licen[cs]e
licensed | licen | published under (?:the |a |an )?(?:\w+ ){0,3}licen[cs]e
licensed | licen | available under (?:the |a |an )?(?:\w+ ){0,3}licen[cs]e
licensed | licen | under the terms of the (?:\w+ ){0,4}licen[cs]e
licensed | licen | see (?:the )?licen[cs]e(?: file| text)?(?: for details)?
licensed | licen | licen[cs]e(?: agreement| notice| terms| information)
open-source | open source | open source (?:licen[cs]e|software)
open-source | free software | free software (?:foundation|licen[cs]e)
copyleft | copyleft | copyleft
copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright | copyright | copyright (?:notice|holders?|owners?)
copyright | copyrighted | copyrighted(?: material| work)?
copyright | copyright | (?:c )?copyright
trademark | trademark | (?:registered )?trademarks? of
patent | patent | patents? (?:pending|licen[cs]e|grant)
terms | terms of | terms of (?:use|service)
terms | terms and conditions | terms and conditions
terms | privacy policy | privacy policy
fair-use | fair use | fair use
royalty-free | royalty free | royalty free(?: licen[cs]e)?
no-rights | no rights reserved | no rights reserved
some-rights | some rights reserved | some rights reserved
licensed-de | lizenz | (?:lizenziert|veröffentlicht|freigegeben) unter (?:der |einer )?(?:\w+ ){0,3}lizenz
reserved-de | rechte vorbehalten | alle rechte vorbehalten
licensed-fr | licence | (?:sous|selon) (?:la |une )?licence
reserved-fr | droits réservés | tous droits réservés
licensed-es | licencia | (?:bajo|según) (?:la |una )?licencia
reserved-es | derechos reservados | todos los derechos reservados
"""

#: Confidence of a section's matches, and of a base phrase.
CONFIDENCE = (1.0, 0.95, 0.85, 0.5)
BASE_CONFIDENCE = 0.8

#: Phrases whose every place counts and whose labels nothing suppresses.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def rules() -> list[tuple[int, str, str, str]]:
    """(section, label, keyword, pattern) of every rule, in order."""
    out = []
    for section, block in enumerate(RULES.strip().split("\n--\n")):
        for line in block.split("\n"):
            label, keyword, pattern = line.split(" | ")
            whole = pattern.replace("\\w", "[^ ]").replace("\\d", "[0-9]")
            out.append((section, label, keyword, whole))
    return out
