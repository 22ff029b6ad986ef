"""License scans with ordered signature rules, in DataFrame expressions only.

Texts are lower-cased (A-Z) and read as words; the words stand in a *normal form* with a space of their own on either
side, so phrases are found by plain search and neighbours never share a character. A prefilter of stems picks the texts
that can match anything; in these a rule's regular expression runs only if all its keywords occur. A detection that lies
inside another of the same or a higher priority is suppressed, and of those with one interval and priority the first by
label stays; the labels of the others are kept. The base phrases are counted apart and always keep their labels.

There are over 300 rules, written by hand: wording of licenses and notices, identifier lines, statements, names. Null
texts are empty; every row is scanned whole and on its own, very long ones too, so repeats give equal rows. An empty
table gives no rows. Columns besides doc_id and text are left out, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Rules, one a line: label; priority; keywords, which every text that the pattern matches has; regular expression over
#: normal words. Priorities: 6 wording of the license itself or of its notice, 5 identifier lines, 4 what a work is said to
#: be under, 3 full names, 2 names in part, 1 mere mentions.
RULES = r"""# --- permissive: texts, notices, statements, names
mit; 6; permission granted charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 6; permission notice shall; the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit; 5; spdx mit; spdx license identifier mit
mit; 4; licensed mit; (?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of )?(?:the )?mit(?: x11)?(?: license| licence)?
mit; 4; released mit; (?:is |are )?released under (?:the )?(?:terms of )?(?:the )?mit(?: license| licence)?
mit; 4; distributed mit; (?:is |are )?distributed under (?:the )?(?:terms of )?(?:the )?mit(?: license| licence)?
mit; 4; available mit; (?:is |are )?(?:made )?available under (?:the )?(?:terms of )?(?:the )?mit(?: license| licence)?
mit; 3; mit license; the mit license
mit; 3; mit license; license (?:is )?mit
mit; 3; mit style; mit style (?:license|licence)
mit; 2; mit license; mit license
mit; 2; mit licence; mit licence
mit; 2; expat license; expat license
mit-0; 6; permission granted charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-0; 5; spdx mit; spdx license identifier mit 0
mit-0; 3; mit attribution; mit no attribution(?: license)?
x11; 3; x11 license; x11 license
x11; 6; consortium advertising; except as contained in this notice the name of the x consortium shall not be used in advertising
mit-modern-variant; 6; permission granted agreement; permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software
isc; 6; permission modify fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 6; permission modify fee; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc; 5; spdx isc; spdx license identifier isc
isc; 4; licensed isc; licensed under (?:the )?(?:terms of )?(?:the )?isc(?: license)?
isc; 4; released isc; released under (?:the )?(?:terms of )?(?:the )?isc(?: license)?
isc; 2; isc license; isc license
hpnd; 6; permission fee; permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
0bsd; 5; spdx 0bsd; spdx license identifier 0bsd
0bsd; 2; 0bsd; 0bsd(?: license)?
0bsd; 3; zero bsd; (?:bsd zero clause|zero clause bsd)(?: license)?
apache-2.0; 6; apache version january; apache license version 2 0 january 2004
apache-2.0; 6; apache compliance; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0; 6; apache licenses; you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0; 5; spdx apache; spdx license identifier apache 2 0
apache-2.0; 4; licensed apache; (?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)? (?:version |v )?2(?: 0)?(?: license)?
apache-2.0; 4; licensed apache; (?:is |are )?(?:dual )?licensed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)? v2(?: 0)?(?: license)?
apache-2.0; 4; released apache; (?:is |are )?released under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)? (?:version |v )?v?2(?: 0)?(?: license)?
apache-2.0; 4; distributed apache; (?:is |are )?distributed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)? (?:version |v )?v?2(?: 0)?(?: license)?
apache-2.0; 4; available apache; (?:is |are )?available under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)? (?:version |v )?v?2(?: 0)?(?: license)?
apache-2.0; 3; apache license; apache (?:software )?license (?:version |v )?v?2(?: 0)?
apache-2.0; 2; apache; apache (?:version |v )?v?2(?: 0)?(?: license)?
apache-2.0; 2; asl; asl 2 0
apache-1.1; 6; apache; this product includes software developed by the apache software foundation
apache-1.1; 5; spdx apache; spdx license identifier apache 1 1
apache-1.1; 3; apache license; apache (?:software )?license (?:version |v )?1 1
apache-1.0; 5; spdx apache; spdx license identifier apache 1 0
apache-1.0; 3; apache license; apache (?:software )?license (?:version |v )?1 0
apache; 4; licensed apache; licensed under (?:the )?(?:terms of )?(?:the )?apache (?:software )?license
apache; 2; apache license; apache (?:software )?license
bsd-3-clause; 6; neither endorse; neither the name of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
bsd-3-clause; 6; endorse promote name; the name of the author may not be used to endorse or promote products derived from this software
bsd-3-clause; 5; spdx bsd; spdx license identifier bsd 3 clause
bsd-3-clause; 4; licensed bsd; licensed under (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?
bsd-3-clause; 4; released bsd; released under (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?
bsd-3-clause; 3; bsd clause; (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?
bsd-3-clause; 3; bsd license; (?:new|modified|revised) bsd license
bsd-3-clause-clear; 6; patent granted express; no express or implied licenses to any party s patent rights are granted by this license
bsd-3-clause-clear; 5; spdx bsd; spdx license identifier bsd 3 clause clear
bsd; 6; redistribution source binary; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause; 5; spdx bsd; spdx license identifier bsd 2 clause
bsd-2-clause; 4; licensed bsd; licensed under (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?
bsd-2-clause; 3; bsd clause; (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?
bsd-2-clause; 3; bsd license; simplified bsd license
bsd-2-clause; 3; freebsd license; freebsd license
bsd-2-clause-patent; 5; spdx bsd; spdx license identifier bsd 2 clause patent
bsd-4-clause; 6; advertising materials; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause; 5; spdx bsd; spdx license identifier bsd 4 clause
bsd-4-clause; 3; bsd clause; (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: license)?
bsd-4-clause; 3; bsd license; original bsd license
bsd; 4; licensed bsd; licensed under (?:the )?(?:terms of )?(?:a |the )?bsd(?: style)?(?: license)?
bsd; 4; released bsd; released under (?:the )?(?:terms of )?(?:a |the )?bsd(?: style)?(?: license)?
bsd; 4; distributed bsd; distributed under (?:the )?(?:terms of )?(?:a |the )?bsd(?: style)?(?: license)?
bsd; 3; bsd style; bsd style license
bsd; 2; bsd license; bsd license
bsd; 6; redistributions retain disclaimer; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
zlib; 6; misrepresented origin; the origin of this software must not be misrepresented
zlib; 6; warranty provided express; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib; 5; spdx zlib; spdx license identifier zlib
zlib; 4; licensed zlib; licensed under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)?(?: license)?
zlib; 2; zlib license; zlib(?: libpng)? license
libpng; 6; png; the png reference library is supplied as is
bsl-1.0; 6; permission; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0; 6; boost accompanying; distributed under the boost software license version 1 0 see accompanying file
bsl-1.0; 5; spdx bsl; spdx license identifier bsl 1 0
bsl-1.0; 4; licensed boost; licensed under (?:the )?boost software license(?: version 1 0)?
bsl-1.0; 3; boost license; boost software license(?: version| v)?(?: 1 0)?
unlicense; 6; unencumbered domain; this is free and unencumbered software released into the public domain
unlicense; 5; spdx unlicense; spdx license identifier unlicense
unlicense; 2; unlicense; (?:the )?unlicense
wtfpl; 6; fuck want; do what the fuck you want to public license
wtfpl; 5; spdx wtfpl; spdx license identifier wtfpl
wtfpl; 2; wtfpl; wtfpl
postgresql; 6; postgresql database; postgresql database management system formerly known as postgres
postgresql; 3; postgresql license; (?:the )?postgresql license
ncsa; 3; illinois ncsa; university of illinois ncsa open source license
ncsa; 5; spdx ncsa; spdx license identifier ncsa
python-2.0; 6; python; this license agreement is between the python software foundation
python-2.0; 5; spdx; spdx license identifier (?:python|psf) 2 0
python-2.0; 3; python license; python software foundation license(?: version 2)?
php-3.01; 6; php; the name php must not be used to endorse or promote products derived from this software
php-3.01; 3; php license; php license (?:version |v )?3 0 ?1
php; 2; php license; (?:the )?php license
openssl; 6; openssl toolkit; this product includes software developed by the openssl project for use in the openssl toolkit
openssl; 3; openssl license; openssl license
curl; 3; curl license; curl license
ftl; 3; freetype license; freetype (?:project )?license
ijg; 6; jpeg independent; this software is based in part on the work of the independent jpeg group
afl-3.0; 5; spdx afl; spdx license identifier afl 3 0
afl-3.0; 3; academic license; academic free license (?:version |v )?v?3 0
afl; 2; academic license; academic free license
artistic-2.0; 5; spdx artistic; spdx license identifier artistic 2 0
artistic-2.0; 3; artistic license; (?:the )?artistic license (?:version )?2(?: 0)?
artistic-1.0; 5; spdx artistic; spdx license identifier artistic 1 0(?: perl)?
artistic-1.0; 6; conditions document; the intent of this document is to state the conditions under which a package may be copied
artistic; 2; artistic license; (?:the )?artistic license
perl; 4; perl terms; (?:under )?the same terms as perl(?: itself)?
ruby; 3; ruby license; ruby license
ruby; 5; spdx ruby; spdx license identifier ruby
w3c; 3; w3c license; w3c software (?:notice and )?license
unicode; 3; unicode license; unicode license(?: v3| agreement)?
upl-1.0; 3; universal permissive; universal permissive license(?: version 1 0| v 1 0)?
blueoak-1.0.0; 3; blue oak; blue oak model license(?: version)?(?: 1 0 0)?
ms-pl; 3; microsoft public; microsoft public license
ms-rl; 3; microsoft reciprocal; microsoft reciprocal license
ecl-2.0; 3; educational community; educational community license(?: version 2 0)?
osl-3.0; 3; open software; open software license(?: (?:version |v )?3 0)?
qpl; 3; public license q; q public license
vim; 2; vim license; vim license
json; 6; software shall good evil; the software shall be used for good not evil
beerware; 6; beer buy; if we meet some day and you think this stuff is worth it you can buy me a beer
beerware; 2; license; beer ?ware license
# --- copyleft: texts, notices, statements, names
gpl-1.0-only; 5; spdx gpl; spdx license identifier gpl 1 0(?: only)?
gpl-1.0-or-later; 5; spdx gpl; spdx license identifier gpl 1 0 or later
gpl-1.0; 3; general public; (?:gnu )?general public license (?:version |v )1
gpl-2.0; 6; general public june; gnu general public license version 2 june 1991
gpl-2.0-or-later; 6; redistribute modify either option; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-only; 6; redistribute modify foundation; this program is free software you can redistribute it and or modify it under the terms of (?:the gnu general public license version 2|version 2 of the gnu general public license) as published by the free software foundation
gpl-3.0; 6; general public june; gnu general public license version 3 29 june 2007
gpl-3.0-or-later; 6; redistribute modify either option; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0-only; 6; redistribute modify foundation; this program is free software you can redistribute it and or modify it under the terms of (?:the gnu general public license version 3|version 3 of the gnu general public license) as published by the free software foundation
gpl; 6; free program; this program is free software
gpl; 6; redistribute modify general; you can redistribute it and or modify it under the terms of the gnu general public license
gpl; 6; details; see the gnu general public license for more details
gpl; 6; received copy general; you should have received a copy of the gnu general public license
gpl; 6; licenses designed freedom; the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl-2.0-only; 5; spdx gpl; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later; 5; spdx gpl; spdx license identifier gpl 2 0 or later
gpl-3.0-only; 5; spdx gpl; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later; 5; spdx gpl; spdx license identifier gpl 3 0 or later
gpl-2.0; 4; licensed general public; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license (?:version |v )2(?: 0)?
gpl-2.0; 4; licensed general public; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license v2(?: 0)?
gpl-3.0; 4; licensed general public; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license (?:version |v )3(?: 0)?
gpl-3.0; 4; licensed general public; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license v3(?: 0)?
gpl-2.0; 4; licensed gpl; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl (?:version |v )?v?2(?: 0)?
gpl-3.0; 4; licensed gpl; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl (?:version |v )?v?3(?: 0)?
gpl-2.0; 4; licensed gplv2; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gplv2(?: 0)?
gpl-3.0; 4; licensed gplv3; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gplv3(?: 0)?
gpl-2.0; 4; released gpl; released under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl (?:version |v )?v?2(?: 0)?
gpl-3.0; 4; released gpl; released under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl (?:version |v )?v?3(?: 0)?
gpl-2.0-only; 3; gpl only; gpl (?:version |v )?v?2(?: 0)? only
gpl-2.0-or-later; 3; gpl later; gpl (?:version |v )?v?2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-only; 3; gpl only; gpl (?:version |v )?v?3(?: 0)? only
gpl-3.0-or-later; 3; gpl later; gpl (?:version |v )?v?3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0-or-later; 3; general public later; (?:gnu )?general public license (?:version |v )?v?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-or-later; 3; general public later; (?:gnu )?general public license (?:version |v )?v?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later; 3; gplv2 later; gplv2(?: 0)? or later
gpl-3.0-or-later; 3; gplv3 later; gplv3(?: 0)? or later
gpl-2.0; 3; general public; (?:gnu )?general public license (?:version |v )2(?: 0)?
gpl-2.0; 3; general public; (?:gnu )?general public license v2(?: 0)?
gpl-3.0; 3; general public; (?:gnu )?general public license (?:version |v )3(?: 0)?
gpl-3.0; 3; general public; (?:gnu )?general public license v3(?: 0)?
gpl-2.0; 2; gpl; gpl (?:version |v )?v?2(?: 0)?
gpl-3.0; 2; gpl; gpl (?:version |v )?v?3(?: 0)?
gpl-2.0; 2; gplv2; gplv2(?: 0)?
gpl-3.0; 2; gplv3; gplv3(?: 0)?
gpl-2.0; 2; gpl2; gpl2
gpl-3.0; 2; gpl3; gpl3
gpl; 2; gnu general public; gnu general public license
gpl; 2; gpl; gnu gpl
gpl; 1; gpl; gpl
gpl-classpath-exception; 5; classpath; with classpath exception 2 0
gpl-classpath-exception; 6; linking; linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-classpath-exception; 2; classpath exception; classpath exception
gcc-exception; 5; gcc exception; with gcc exception (?:2 0|3 1)
gcc-exception; 3; gcc runtime; gcc runtime library exception
linux-syscall-note; 5; linux syscall; with linux syscall note
llvm-exception; 5; llvm exception; with llvm exception
lgpl-2.0; 6; library general public; gnu library general public license version 2 june 1991
lgpl-2.1; 6; lesser general february; gnu lesser general public license version 2 1 february 1999
lgpl-3.0; 6; lesser general june; gnu lesser general public license version 3 29 june 2007
lgpl-2.1-or-later; 6; library redistribute option; this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later; 6; lesser option; under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl; 6; library free redistribute; this library is free software you can redistribute it and or modify it
lgpl-2.0-or-later; 5; spdx lgpl; spdx license identifier lgpl 2 0 or later
lgpl-2.1-only; 5; spdx lgpl; spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later; 5; spdx lgpl; spdx license identifier lgpl 2 1 or later
lgpl-3.0-only; 5; spdx lgpl; spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later; 5; spdx lgpl; spdx license identifier lgpl 3 0 or later
lgpl-2.1; 4; licensed lesser; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public license (?:version |v )?v?2(?: 1)?
lgpl-3.0; 4; licensed lesser; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public license (?:version |v )?v?3(?: 0)?
lgpl-2.1; 4; licensed lgpl; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl (?:version |v )?v?2 1
lgpl-3.0; 4; licensed lgpl; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl (?:version |v )?v?3(?: 0)?
lgpl-2.1; 3; lesser general; (?:gnu )?lesser general public license (?:version |v )?v?2(?: 1)?
lgpl-3.0; 3; lesser general; (?:gnu )?lesser general public license (?:version |v )?v?3(?: 0)?
lgpl-2.0; 3; library general; (?:gnu )?library general public license(?: (?:version |v )?v?2(?: 0)?)?
lgpl-2.1; 2; lgpl; lgpl (?:version |v )?v?2 1
lgpl-2.0; 2; lgpl; lgpl (?:version |v )?v?2(?: 0)?
lgpl-3.0; 2; lgpl; lgpl (?:version |v )?v?3(?: 0)?
lgpl-2.1; 2; lgplv2; lgplv2(?: 1)?
lgpl-3.0; 2; lgplv3; lgplv3(?: 0)?
lgpl; 2; lesser general; (?:gnu )?lesser general public license
lgpl; 1; lgpl; lgpl
agpl-3.0; 6; affero general november; gnu affero general public license version 3 19 november 2007
agpl-3.0-or-later; 6; affero option; under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0-only; 5; spdx agpl; spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later; 5; spdx agpl; spdx license identifier agpl 3 0 or later
agpl-3.0; 4; licensed affero; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public license(?: (?:version |v )?v?3(?: 0)?)?
agpl-3.0; 4; licensed agplv3; licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agplv3(?: 0)?
agpl-3.0; 3; affero general; (?:gnu )?affero general public license (?:version |v )?v?3(?: 0)?
agpl-3.0; 2; agpl; agpl (?:version |v )?v?3(?: 0)?
agpl-3.0; 2; agplv3; agplv3(?: 0)?
agpl; 2; affero general; (?:gnu )?affero general public license
agpl; 1; agpl; agpl
gfdl-1.3; 6; documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 [123]
gfdl-1.3; 5; spdx gfdl; spdx license identifier gfdl 1 3(?: only| or later)?
gfdl; 3; documentation license; (?:gnu )?free documentation license(?: (?:version |v )?1 [123])?
gfdl; 1; gfdl; gfdl
mpl-2.0; 6; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1; 6; mozilla contents; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0; 5; spdx mpl; spdx license identifier mpl 2 0
mpl-1.1; 5; spdx mpl; spdx license identifier mpl 1 1
mpl-2.0; 4; licensed mozilla; licensed under (?:the )?(?:terms of )?(?:the )?mozilla public license (?:version |v )?v?2(?: 0)?
mpl-2.0; 3; mozilla public; mozilla public license (?:version |v )?v?2(?: 0)?
mpl-1.1; 3; mozilla public; mozilla public license (?:version |v )?v?1 1
mpl-2.0; 2; mpl; mpl (?:version |v )?v?2(?: 0)?
mpl-2.0; 2; mplv2; mplv2(?: 0)?
mpl-1.1; 2; mpl; mpl (?:version |v )?v?1 1
mpl; 2; mozilla public; mozilla public license
epl-1.0; 6; eclipse accompanying; this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0
epl-2.0; 6; eclipse accompanying; this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1.0; 5; spdx epl; spdx license identifier epl 1 0
epl-2.0; 5; spdx epl; spdx license identifier epl 2 0
epl-2.0; 3; eclipse public; eclipse public license (?:version |v )?v?2(?: 0)?
epl-1.0; 3; eclipse public; eclipse public license (?:version |v )?v?1(?: 0)?
epl-2.0; 2; epl; epl (?:version |v )?v?2(?: 0)?
epl-1.0; 2; epl; epl (?:version |v )?v?1(?: 0)?
epl; 2; eclipse public; eclipse public license
edl-1.0; 3; eclipse distribution; eclipse distribution license(?: (?:version |v )?1 0)?
cddl-1.0; 5; spdx cddl; spdx license identifier cddl 1 0
cddl-1.1; 5; spdx cddl; spdx license identifier cddl 1 1
cddl; 3; common development distribution; common development and distribution license(?: (?:version |v )?1 [01])?
cddl; 2; cddl; cddl(?: 1 [01])?
cpl-1.0; 3; common public; common public license(?: (?:version |v )?1 0)?
ipl-1.0; 3; ibm public; ibm public license(?: (?:version |v )?1 0)?
eupl-1.2; 5; spdx eupl; spdx license identifier eupl 1 2
eupl-1.1; 5; spdx eupl; spdx license identifier eupl 1 1
eupl; 3; european union public; european union public licen[cs]e(?: (?:version |v )?v?1 [12])?
eupl; 2; eupl; eupl(?: v?1 [12])?
cecill-2.1; 5; spdx cecill; spdx license identifier cecill 2 1
cecill; 2; cecill; (?:the )?cecill(?: b| c)?(?: license)?(?: 2 [01])?
sspl-1.0; 3; server side public; server side public license(?: (?:version |v )?1)?
busl-1.1; 3; business source; business source license(?: (?:version |v )?1 1)?
elastic-2.0; 3; elastic license; elastic license(?: (?:version |v )?2(?: 0)?)?
polyform; 3; polyform; polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license(?: 1 0 0)?
commons-clause; 3; commons clause; commons clause(?: license condition| restriction)?(?: v1 0)?
openrail; 3; openrail license; (?:creativeml )?openrail(?: m| s)? license
openrail; 2; openrail; (?:bigscience |creativeml )?openrail(?: m| s)?
llama-community; 3; llama community; llama [23](?: [0-9])? community license(?: agreement)?
# --- documents, data, fonts
cc0-1.0; 6; affirmer waives; affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0; 5; spdx cc0; spdx license identifier cc0 1 0
cc0-1.0; 3; cc0 universal; cc0 1 0 universal(?: public domain dedication)?
cc0-1.0; 2; cc0; cc0(?: 1 0)?
cc0-1.0; 4; cc0; (?:licensed|released) under (?:the )?cc0(?: 1 0)?(?: license)?
cc-by-nc-nd-4.0; 5; spdx cc nd; spdx license identifier cc by nc nd 4 0
cc-by-nc-sa-4.0; 5; spdx cc sa; spdx license identifier cc by nc sa 4 0
cc-by-nc-4.0; 5; spdx cc nc; spdx license identifier cc by nc 4 0
cc-by-nd-4.0; 5; spdx cc nd; spdx license identifier cc by nd 4 0
cc-by-sa-4.0; 5; spdx cc sa; spdx license identifier cc by sa 4 0
cc-by-4.0; 5; spdx cc by; spdx license identifier cc by 4 0
cc-by-nc-nd; 4; licensed cc nd; licensed under (?:a |the )?cc by nc nd(?: [1-4] [05])?(?: license)?
cc-by-nc-sa; 4; licensed cc sa; licensed under (?:a |the )?cc by nc sa(?: [1-4] [05])?(?: license)?
cc-by-nc; 4; licensed cc nc; licensed under (?:a |the )?cc by nc(?: [1-4] [05])?(?: license)?
cc-by-nd; 4; licensed cc nd; licensed under (?:a |the )?cc by nd(?: [1-4] [05])?(?: license)?
cc-by-sa; 4; licensed cc sa; licensed under (?:a |the )?cc by sa(?: [1-4] [05])?(?: license)?
cc-by-4.0; 4; licensed cc by; licensed under (?:a |the )?cc by 4 0(?: license)?
cc-by-nc-nd; 2; cc nc nd; cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa; 2; cc nc sa; cc by nc sa(?: [1-4] [05])?
cc-by-nc; 2; cc by nc; cc by nc(?: [1-4] [05])?
cc-by-nd; 2; cc by nd; cc by nd(?: [1-4] [05])?
cc-by-sa; 2; cc by sa; cc by sa(?: [1-4] [05])?
cc-by-4.0; 2; cc by; cc by 4 0
cc-by-3.0; 2; cc by; cc by 3 0
cc-by-2.5; 2; cc by; cc by 2 5
cc-by-2.0; 2; cc by; cc by 2 0
cc-by-nc-nd; 3; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa; 3; creative commons attribution; creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc; 3; creative commons attribution; creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nd; 3; creative commons attribution; creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-sa; 3; creative commons attribution; creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-4.0; 3; creative commons attribution; creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0; 3; creative commons attribution; creative commons attribution 3 0(?: unported)?(?: license)?
creative-commons; 2; creative commons; creative commons(?: attribution)?(?: license)?
creative-commons; 3; creativecommons licenses; creativecommons org licenses
cc-zero-link; 3; creativecommons publicdomain; creativecommons org publicdomain zero 1 0
odbl-1.0; 3; open database; open (?:data commons open )?database license(?: (?:version |v )?v?1 0)?
odbl-1.0; 2; odbl; odbl(?: 1 0)?
odc-by; 3; open data commons; open data commons attribution license(?: (?:version |v )?v?1 0)?
odc-by; 2; odc by; odc by(?: 1 0)?
pddl; 3; public domain dedication; public domain dedication and license
cdla-permissive; 3; community data license; community data license agreement permissive(?: (?:version )?[12] 0)?
cdla-sharing; 3; community data license; community data license agreement sharing(?: (?:version )?1 0)?
ogl-uk; 3; open government; open government licen[cs]e(?: v[123])?(?: 0)?
ofl-1.1; 6; font licensed sil; this font software is licensed under the sil open font license version 1 1
ofl-1.1; 5; spdx ofl; spdx license identifier ofl 1 1
ofl-1.1; 3; sil font; sil open font license(?: (?:version |v )?1 1)?
ofl-1.1; 2; open font; open font license
ofl-1.1; 2; ofl; ofl 1 1
gust-font; 3; gust font; gust font license
bitstream-vera; 6; bitstream vera; bitstream vera is a trademark of bitstream
# --- reservations and the public domain
public-domain; 4; public domain; (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain; 4; public domain; (?:is|are) in the public domain
public-domain; 1; public domain; public domain
proprietary; 4; proprietary confidential; proprietary and confidential
proprietary; 4; unauthorized; unauthorized (?:copying|reproduction|distribution) of this (?:file|document|software|material)(?: via any medium)? is strictly prohibited
proprietary; 4; contains of; contains (?:confidential|proprietary)(?: and proprietary| and confidential)? (?:information|trade secrets) of
proprietary; 3; license agreement user; end user license agreement
proprietary; 3; permission; (?:may not|no part .{1,60}? may) be (?:reproduced|copied|distributed|transmitted).{1,120}? without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary; 3; rights reserved; all rights reserved no part of this
no-commercial-use; 3; use; for non ?commercial use only
no-commercial-use; 3; personal use; for personal use only
no-commercial-use; 3; purposes; for (?:academic|research)(?: and (?:academic|research))? purposes only
no-ai-training; 3; train; may not be used to train (?:any )?(?:machine learning|artificial intelligence|ai|language)(?: learning)? (?:models|systems)
no-ai-training; 3; mining reserved; text and data mining(?: rights)? (?:is|are) (?:expressly )?reserved
warranty-disclaimer; 1; warranty kind; without warranty of any kind
warranty-disclaimer; 1; warranties conditions; without warranties or conditions of any kind
copyright-notice; 1; copyright rights; copyright (?:c )?(?:19|20)[0-9][0-9] .{1,80}? all rights reserved
"""
#: How sure a detection of a priority is.
CONFIDENCE = {6: 1.0, 5: 1.0, 4: 0.95, 3: 0.8, 2: 0.6, 1: 0.4}
#: Of these every text that a rule can match has one; a blank at the front is the beginning of a word.
GATES = [
    "licen", "copyright", "copyleft", "permission", "redistribut", "public domain", "apache", "warrant",
    "proprietary", "confidential", "gpl", " bsd", " asl 2", " cc0", " cc by", " odbl", " odc by", " ofl 1", " mpl",
    " epl", " wtfpl", " cddl", " eupl", " cecill", " mit style", " mit no", " openrail", " gfdl", " 0bsd",
    "creative commons", "creativecommons", "commons clause", "misrepresent", "as perl", "zero bsd", "endorse",
    "good not evil", "a beer", " beer ware", " beerware", " exception", "syscall", "released under", "distributed under", "available under",
    "x consortium", "advertising materials", "png reference", "postgresql", "openssl", "jpeg group",
    "free software", "may be copied", "statically or dynamically", "affirmer", "bitstream vera", "unauthorized",
    "rights reserved no part", "use only", "purposes only", "used to train", "data mining",
]


def _spaced(words: str) -> str:
    """Single spaces between words as they stand in the normal form; " ?" may part two words or not."""
    return words.replace(" ?", "(?: )?").replace(" ", "  ")


def rules() -> list[tuple[str, list[str], str, int, float]]:
    """label, keywords, regular expression over the normal form, priority, confidence."""
    out = []
    for line in RULES.splitlines():
        if line and not line.startswith("#"):
            label, priority, keywords, pattern = line.split("; ", 3)
            out.append((label, keywords.split(), f" {_spaced(pattern)} ", int(priority), CONFIDENCE[int(priority)]))
    return out


def normal_form(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text, A-Z lower-cased, each as " word "."""
    # lower() also maps two characters beyond ASCII to ASCII letters; they are swapped for others first
    plain = F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ĸ")))
    words = F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(words == "", words).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(form: Column) -> Column:
    return ((F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit("")))) / 2).cast("long")


def base_places(form: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column, Column]:
    """Whether the phrase occurs, how often, and its first and last place in words."""
    spaced = " " + phrase.replace(" ", "  ") + " "
    has = F.contains(form, F.lit(spaced))
    count = F.when(has, ((F.length(form) - F.length(F.replace(form, F.lit(spaced), F.lit("")))) / len(spaced)).cast("long")).otherwise(F.lit(0).cast("long"))
    before = F.substr(form, F.lit(1), F.instr(form, spaced) - 1)
    back = F.reverse(form)
    after = F.substr(back, F.lit(1), F.instr(back, spaced[::-1]) - 1)
    return has, count, F.when(has, _words(before)), F.when(has, n_words - _words(after) - len(phrase.split()))


def detections(form: Column) -> Column:
    """What the rules find and suppression leaves: struct(labels, confidence)."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    literal = F.expr("array(" + ", ".join(f"named_struct('label', {q(label)}, 'words', array({', '.join(map(q, words))}), 'pattern', {q(pattern)}, 'priority', {priority}, 'confidence', {confidence}D)" for label, words, pattern, priority, confidence in rules()) + ")")
    keywords = sorted({k for _, words, *_ in rules() for k in words})
    present = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(form, F.concat(F.lit(" "), k, F.lit(" "))))
    # a lambda's argument is computed once for a text, an expression inside a lambda once for a rule
    able = F.flatten(F.transform(F.array(present), lambda words: F.filter(literal, lambda r: F.size(F.array_except(r["words"], words)) == 0)))

    def places(r: Column) -> Column:
        found = F.regexp_extract_all(form, r["pattern"], F.lit(0))
        gaps = F.split(form, r["pattern"], F.lit(-1))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,back:int,rank:int,label:string,confidence:double>>)").alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + x["gap"]
            one = F.struct(begin.alias("start"), (-(begin + x["size"])).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence"))
            return F.struct((begin + x["size"]).alias("at"), F.array_append(a["out"], one).alias("out"))

        pairs = F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(found)), F.transform(found, F.length), lambda g, m: F.struct(g.alias("gap"), m.alias("size")))
        return F.aggregate(pairs, start, step, lambda a: a["out"])

    found = F.array_sort(F.flatten(F.transform(able, places)))
    levels = sorted(CONFIDENCE)
    # in order of start, longest and highest first: an interval is inside an earlier one iff that one ends no sooner
    empty = F.struct(*(F.lit(0).alias(f"m{p}") for p in levels), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("confidence"))

    def keep(a: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["rank"]
        covered = F.lit(False)
        for p in levels:
            covered = covered | ((priority <= p) & (a[f"m{p}"] >= end))
        return F.struct(
            *(F.when(priority == p, F.greatest(a[f"m{p}"], end)).otherwise(a[f"m{p}"]).alias(f"m{p}") for p in levels),
            F.when(covered, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"),
            F.when(covered, a["confidence"]).otherwise(F.greatest(a["confidence"], d["confidence"])).alias("confidence"),
        )

    return F.aggregate(found, empty, keep, lambda a: F.struct(a["labels"].alias("labels"), a["confidence"].alias("confidence")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text)."""
    form, n = F.col("form"), F.col("n_words")
    rows = docs.select("doc_id", normal_form(F.col("text")).alias("form")).withColumn("n_words", _words(form))
    places = {label: base_places(form, n, phrase) for phrase, label in BASE.items()}
    counts, firsts, lasts = ([p[k] for p in places.values()] for k in (1, 2, 3))
    labels = F.filter(F.array(*(F.when(p[0], F.lit(label)) for label, p in places.items())), lambda x: x.isNotNull())
    gate = F.lit(False)
    for stem in GATES:
        gate = gate | F.contains(form, F.lit(stem.replace(" ", "  ")[stem.startswith(" ") :]))
    none = F.struct(F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("confidence"))
    rows = rows.select(
        "doc_id", "n_words",
        sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        labels.alias("base"), F.when(gate, detections(form)).otherwise(none).alias("found"),
    )
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found.labels")), ",").alias("labels"),
        F.greatest(F.col("found.confidence"), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op6_license_signatures(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
