"""Signatures of licenses, one a line, in order of priority: label, keyword, how sure it is, regex over words.

A text is matched as its lower-case words, one space apart: ``LICENSE-2.0`` is ``license 2 0``. The keyword is a word
of every match; it gates the rule. Signatures are of bounded length: they have no repeat without a limit.
"""

from __future__ import annotations

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RULES = r"""
# Tags and addresses: what tools write, and where texts of licenses lie
apache     spdx      1.0  spdx licen[cs]e identifier apache 2 0(?: with llvm exception)?
apache     spdx      1.0  spdx licen[cs]e identifier apache 1 [01]
mit        spdx      1.0  spdx licen[cs]e identifier (?:x11|mit)(?: 0)?
bsd        spdx      1.0  spdx licen[cs]e identifier bsd [0-4] clause(?: patent| clear)?
isc        spdx      1.0  spdx licen[cs]e identifier isc
gpl        spdx      1.0  spdx licen[cs]e identifier gpl [1-3] 0(?: only| or later)?
gpl        spdx      1.0  spdx licen[cs]e identifier gpl 2 0 (?:only |or later )?with (?:linux syscall note|classpath exception 2 0|gcc exception [23] [01])
lgpl       spdx      1.0  spdx licen[cs]e identifier lgpl (?:2 [01]|3 0)(?: only| or later)?
agpl       spdx      1.0  spdx licen[cs]e identifier agpl [13] 0(?: only| or later)?
gfdl       spdx      1.0  spdx licen[cs]e identifier gfdl 1 [1-3](?: only| or later| invariants only| no invariants only)?
mpl        spdx      1.0  spdx licen[cs]e identifier mpl (?:1 [01]|2 0)(?: no copyleft exception)?
epl        spdx      1.0  spdx licen[cs]e identifier epl [12] 0
cddl       spdx      1.0  spdx licen[cs]e identifier cddl 1 [01]
cc0        spdx      1.0  spdx licen[cs]e identifier cc0 1 0
cc-by-nc-nd spdx     1.0  spdx licen[cs]e identifier cc by nc nd [1-4] [05]
cc-by-nc-sa spdx     1.0  spdx licen[cs]e identifier cc by nc sa [1-4] [05]
cc-by-nc   spdx      1.0  spdx licen[cs]e identifier cc by nc [1-4] [05]
cc-by-nd   spdx      1.0  spdx licen[cs]e identifier cc by nd [1-4] [05]
cc-by-sa   spdx      1.0  spdx licen[cs]e identifier cc by sa [1-4] [05]
cc-by      spdx      1.0  spdx licen[cs]e identifier cc by [1-4] [05]
unlicense  spdx      1.0  spdx licen[cs]e identifier unlicense
zlib       spdx      1.0  spdx licen[cs]e identifier zlib(?: acknowledgement)?
boost      spdx      1.0  spdx licen[cs]e identifier bsl 1 0
artistic   spdx      1.0  spdx licen[cs]e identifier artistic [12] 0(?: perl| cl8)?
eupl       spdx      1.0  spdx licen[cs]e identifier eupl 1 [0-2]
ofl        spdx      1.0  spdx licen[cs]e identifier ofl 1 [01](?: no rfn| rfn)?
dual       spdx      1.0  spdx licen[cs]e identifier mit or apache 2 0
dual       spdx      1.0  spdx licen[cs]e identifier apache 2 0 or mit
dual       spdx      1.0  spdx licen[cs]e identifier gpl 2 0 (?:only |or later )?or (?:mit|bsd [23] clause)
apache     apache    1.0  https? (?:www )?apache org licen[cs]es licen[cs]e (?:1 [01]|2 0)(?: txt| html)?
mit        mit       1.0  https? (?:www )?opensource org licen[cs]es mit(?: licen[cs]e)?(?: php| html)?
bsd        bsd       1.0  https? (?:www )?opensource org licen[cs]es bsd(?: [23] clause| licen[cs]e)?(?: php| html)?
isc        isc       1.0  https? (?:www )?opensource org licen[cs]es isc(?: licen[cs]e)?(?: txt| php)?
gpl        gnu       1.0  https? (?:www )?gnu org (?:licen[cs]es|copyleft) (?:old licenses )?gpl(?: [123] 0)?(?: en)?(?: html| txt)?
lgpl       gnu       1.0  https? (?:www )?gnu org (?:licen[cs]es|copyleft) (?:old licenses )?(?:lgpl|lesser)(?: [23] [01])?(?: en)?(?: html| txt)?
agpl       gnu       1.0  https? (?:www )?gnu org (?:licen[cs]es|copyleft) agpl(?: 3 0)?(?: en)?(?: html| txt)?
gfdl       gnu       1.0  https? (?:www )?gnu org (?:licen[cs]es|copyleft) fdl(?: 1 [123])?(?: en)?(?: html| txt)?
gpl        gnu       0.9  if not see https? (?:www )?gnu org licen[cs]es
mpl        mozilla   1.0  https? (?:www )?mozilla org mpl(?: (?:1 1|2 0))?(?: txt| html)?
epl        eclipse   1.0  https? (?:www )?eclipse org legal epl (?:v10|v20|2 0)(?: html)?
boost      boost     1.0  https? (?:www )?boost org licen[cs]e 1 0 txt
unlicense  unlicense 1.0  https? (?:www )?unlicense org
ofl        ofl       1.0  https? (?:www )?(?:scripts sil org|openfontlicense org) ofl
odbl       odbl      1.0  https? (?:www )?opendatacommons org licen[cs]es odbl(?: 1 0)?
cc0        zero      1.0  https? creativecommons org publicdomain zero 1 0
public-domain mark   1.0  https? creativecommons org publicdomain mark 1 0
cc-by-nc-nd creativecommons 1.0  https? (?:www )?creativecommons org licen[cs]es by nc nd [1-4] [05]
cc-by-nc-sa creativecommons 1.0  https? (?:www )?creativecommons org licen[cs]es by nc sa [1-4] [05]
cc-by-nc   creativecommons 1.0  https? (?:www )?creativecommons org licen[cs]es by nc [1-4] [05]
cc-by-nd   creativecommons 1.0  https? (?:www )?creativecommons org licen[cs]es by nd [1-4] [05]
cc-by-sa   creativecommons 1.0  https? (?:www )?creativecommons org licen[cs]es by sa [1-4] [05]
cc-by      creativecommons 1.0  https? (?:www )?creativecommons org licen[cs]es by [1-4] [05]

# Apache
apache     apache    1.0  licen[cs]ed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the licen[cs]e
apache     apache    1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e (?:version |v ?)?(?:1 0|1 1|2 0|2)(?: or later)?
apache     apache    1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: 2 0)? licen[cs]e
apache     apache    1.0  dual licen[cs]ed under (?:the )?(?:mit and )?apache(?: 2 0)?
apache     apache    0.9  apache(?: software)? licen[cs]e (?:version |v ?)?(?:1 0|1 1|2 0|2)
apache     apache    0.9  apache (?:v ?)?2(?: 0)? licen[cs]e
apache     apache    0.9  apache 2 0
apache     apache    0.6  apache(?: software)? licen[cs]e
apache     compliance 0.9 you may not use this file except in compliance with the licen[cs]e
apache     obtain    0.6  you may obtain a copy of the licen[cs]e at
apache     basis     0.9  distributed on an as is basis without warranties or conditions of any kind

# GNU
agpl       affero    1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?affero general public licen[cs]e(?: version| v)?(?: 3(?: 0)?)?(?: or later)?
agpl       affero    1.0  redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
agpl       affero    0.9  (?:gnu )?affero general public licen[cs]e (?:version |v ?)?[13](?: 0)?(?: or later| only)?
agpl       affero    0.6  (?:gnu )?affero general public licen[cs]e
agpl       agpl      1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:gnu )?agpl(?: v?3(?: 0)?)?
agpl       agpl      0.9  (?:gnu )?agpl (?:version |v ?)?3(?: 0)?(?: or later| only)?
agpl       agplv3    0.9  (?:gnu )?agplv3(?: or later)?
agpl       agpl      0.6  (?:gnu )?agpl
lgpl       lesser    1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public licen[cs]e(?: version| v)?(?: (?:2 1|2|3 0|3))?(?: or later)?
lgpl       lesser    1.0  redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
lgpl       lesser    0.9  (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?(?:2 1|2|3 0|3)(?: or later| only)?
lgpl       lesser    0.6  (?:gnu )?lesser general public licen[cs]e
lgpl       library   0.9  (?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?(?: or later)?
lgpl       library   0.6  (?:gnu )?library general public licen[cs]e
lgpl       lgpl      1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:gnu )?lgpl(?: (?:v?2 1|v?3|v?2))?
lgpl       lgpl      0.9  (?:gnu )?lgpl (?:version |v ?)?(?:2 1|2|3 0|3)(?: or later| only)?
lgpl       lgplv3    0.9  (?:gnu )?lgplv3(?: or later)?
lgpl       lgplv2    0.9  (?:gnu )?lgplv2(?: 1)?(?: or later)?
lgpl       lgpl      0.6  (?:gnu )?lgpl
gpl        gnu       1.0  redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version [23] of the licen[cs]e or (?:at your option )?any later version
gpl        gnu       1.0  redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl        public    1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e (?:version |v ?)?[123](?: 0)?(?: or later| only)?
gpl        public    1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e
gpl        either    0.9  either version [23] of the licen[cs]e or (?:at your option )?any later version
gpl        gnu       0.6  you should have received a copy of the gnu (?:lesser |affero |library )?general public licen[cs]e
gpl        public    0.9  (?:gnu )?general public licen[cs]e (?:version |v ?)?[123](?: 0)?(?: or later| only)?
gpl        linking   0.9  gpl linking exception
gpl        classpath 0.9  (?:with the )?classpath exception
gpl        permission 0.6  special exception the copyright holders (?:of this library )?give you permission to link
gpl        runtime   0.9  gcc runtime library exception(?: version 3 1)?
gpl        syscall   0.9  linux syscall note
gpl        public    0.6  (?:gnu )?general public licen[cs]e
gpl        gpl       1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:gnu )?gpl(?: (?:version |v ?)?[123](?: 0)?)?(?: or later| only)?
gpl        gpl       1.0  dual licen[cs]ed under (?:the )?(?:mit and |bsd and )?gpl
gpl        gpl       0.9  (?:gnu )?gpl (?:version |v ?)?[123](?: 0)?(?: or later| only)?
gpl        gplv2     0.9  (?:gnu )?gplv2(?: or later)?
gpl        gplv3     0.9  (?:gnu )?gplv3(?: or later)?
gpl        gpl       0.6  gnu gpl
gpl        gpl       0.6  gpl licen[cs]ed?
gpl        copyleft  0.6  strong copyleft licen[cs]e
gfdl       documentation 1.0  permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl       documentation 0.9  (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 [123](?: or any later version)?
gfdl       documentation 0.6  (?:gnu )?free documentation licen[cs]e
gfdl       invariant 0.9  with no invariant sections(?: no front cover texts)?(?: and no back cover texts)?
gfdl       gfdl      0.6  (?:gnu )?gfdl

# Permissive ones
mit        permission 1.0 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit        permission 0.9 permission is hereby granted free of charge to any person obtaining a copy
mit        notice    0.9  the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit        warranty  0.9  the software is provided as is without warranty of any kind express or implied
mit        mit       1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit(?: x11)?(?: licen[cs]e)?
mit        mit       1.0  dual licen[cs]ed under (?:the )?mit
mit        mit       0.6  (?:the )?mit licen[cs]ed?
mit        mit       0.6  mit x11 licen[cs]e
mit        mit       0.9  mit no attribution(?: licen[cs]e)?
mit        expat     1.0  (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?expat licen[cs]e
mit        expat     0.6  expat licen[cs]e
mit        x11       0.6  x11 licen[cs]e
bsd        redistribution 1.0 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd        redistribution 0.9 redistribution and use in source and binary forms
bsd        redistributions 0.9 redistributions of source code must retain the above copyright notice
bsd        redistributions 0.9 redistributions in binary form must reproduce the above copyright notice
bsd        endorse   0.9  neither the name of (?:the )?(?:\S+ ){1,6}nor the names of its contributors may be used to endorse or promote products
bsd        advertising 0.9 all advertising materials mentioning features or use of this software must display
bsd        contributors 0.9 provided by the copyright holders and contributors as is
bsd        bsd       1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:new |modified |simplified |revised )?bsd(?: [0-4] clause)?(?: style)? licen[cs]e
bsd        bsd       1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?[0-4] clause bsd(?: licen[cs]e)?
bsd        bsd       0.6  [0-4] clause bsd(?: licen[cs]e)?
bsd        bsd       0.6  bsd [0-4] clause(?: licen[cs]e)?
bsd        bsd       0.9  (?:new|modified|simplified|revised|original|old) bsd licen[cs]e
bsd        bsd       0.6  bsd style licen[cs]e
bsd        bsd       0.6  bsd licen[cs]ed?
bsd        freebsd   0.6  freebsd licen[cs]e
isc        permission 1.0 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc        permission 0.9 permission to use copy modify and (?:or )?distribute
isc        isc       1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?isc licen[cs]e
isc        isc       0.6  isc licen[cs]ed?
zlib       zlib      1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?zlib(?: libpng)? licen[cs]e
zlib       altered   0.9  altered source versions must be plainly marked as such
zlib       origin    0.9  the origin of this software must not be misrepresented
zlib       zlib      0.6  zlib(?: libpng)? licen[cs]e
boost      boost     1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?boost software licen[cs]e(?: version 1 0)?
boost      boost     0.9  boost software licen[cs]e (?:version |v ?)?1 0
boost      boost     0.6  boost software licen[cs]e
unlicense  unlicense 1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?unlicense
unlicense  unencumbered 1.0 this is free and unencumbered software released into the public domain
unlicense  unlicense 0.6  the unlicense
wtfpl      wtfpl     0.9  wtfpl (?:version |v ?)?[12]
wtfpl      wtfpl     0.6  wtfpl
psf        python    1.0  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?python software foundation licen[cs]e
psf        python    0.9  python software foundation licen[cs]e (?:version |v ?)?2(?: 0)?
psf        python    0.6  python software foundation licen[cs]e
psf        python    0.6  python licen[cs]e
openssl    openssl   0.9  openssl and ssleay licen[cs]es?
openssl    openssl   0.6  openssl licen[cs]e
php        php       0.9  php licen[cs]e (?:version |v ?)?3 0[01]?
php        php       0.6  the php licen[cs]e
ruby       ruby      0.6  ruby licen[cs]e
vim        vim       0.6  vim licen[cs]e
curl       curl      0.6  curl licen[cs]e
ncsa       ncsa      0.6  (?:university of illinois )?ncsa open source licen[cs]e
postgresql postgresql 0.6 postgresql licen[cs]e
beerware   beerware  0.6  beerware licen[cs]e
beerware   beer      0.9  you can buy me a beer in return
json       evil      0.9  the software shall be used for good not evil
fair       fair      0.6  fair licen[cs]e
academic   academic  0.9  academic free licen[cs]e (?:version |v ?)?[123] [01]
academic   academic  0.6  academic free licen[cs]e
blueoak    oak       0.9  blue oak model licen[cs]e(?: 1 0 0)?

# Weak copyleft and company licenses
mpl        mozilla   1.0  this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl        mozilla   1.0  (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mozilla public licen[cs]e(?: version| v)?(?: (?:1 [01]|2 0|2))?
mpl        mozilla   0.9  mozilla public licen[cs]e (?:version |v ?)?(?:1 0|1 1|2 0|2)(?: or later)?
mpl        mozilla   0.6  mozilla public licen[cs]e
mpl        mpl       1.0  (?:licen[cs]ed|released|distributed|available) under (?:the )?mpl(?: (?:version |v ?)?(?:1 1|2 0))?
mpl        mpl       0.9  mpl (?:version |v ?)?(?:1 0|1 1|2 0)
epl        eclipse   1.0  (?:licen[cs]ed|released|distributed|available|made available) under (?:the )?(?:terms of the )?eclipse public licen[cs]e(?: version| v)?(?: [12] 0)?
epl        eclipse   0.9  eclipse public licen[cs]e (?:version |v ?)?[12](?: 0)?
epl        eclipse   0.6  eclipse (?:public|distribution) licen[cs]e
cddl       development 1.0 subject to the terms of the common development and distribution licen[cs]e
cddl       development 0.9 common development and distribution licen[cs]e (?:version |v ?)?1 [01]
cddl       development 0.6 common development and distribution licen[cs]e
cddl       cddl      0.6  cddl(?: 1 [01])?
cpl        common    0.9  common public licen[cs]e (?:version |v ?)?1 0
cpl        common    0.6  common public licen[cs]e
artistic   artistic  1.0  same terms as perl itself under (?:either )?(?:the )?artistic licen[cs]e
artistic   artistic  1.0  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?artistic licen[cs]e(?: (?:version |v ?)?[12] 0)?
artistic   artistic  0.9  artistic licen[cs]e (?:version |v ?)?[12](?: 0)?
artistic   artistic  0.6  artistic licen[cs]e
artistic   perl      0.9  under the same terms as perl itself
eupl       european  1.0  licen[cs]ed under the (?:eupl )?european union public licen[cs]e
eupl       european  0.9  european union public licen[cs]e (?:version |v ?)?1 [012]
eupl       european  0.6  european union public licen[cs]e
eupl       eupl      0.6  eupl(?: v?1 [012])?
cecill     cecill    0.6  cecill(?: [abc12])?(?: licen[cs]e)?
ms-pl      microsoft 0.9  microsoft public licen[cs]e
ms-rl      microsoft 0.9  microsoft reciprocal licen[cs]e
ibm-pl     ibm       0.9  ibm public licen[cs]e
sun        sun       0.6  sun public licen[cs]e
osl        open      0.9  open software licen[cs]e (?:version |v ?)?[123] 0
qpl        q         0.6  q public licen[cs]e
sleepycat  sleepycat 0.6  sleepycat licen[cs]e
sspl       side      0.9  server side public licen[cs]e
bsl        business  0.9  business source licen[cs]e(?: 1 1)?
elastic    elastic   0.9  elastic licen[cs]e(?: 2 0)?
commons-clause clause 0.9 commons clause (?:licen[cs]e )?condition

# Data, fonts and content
ofl        font      1.0  this font software is licen[cs]ed under the sil open font licen[cs]e(?: version 1 1)?
ofl        font      0.9  (?:sil )?open font licen[cs]e (?:version |v ?)?1 [01]
ofl        font      0.6  (?:sil )?open font licen[cs]e
odbl       database  1.0  made available under the open database licen[cs]e
odbl       database  0.9  open (?:data commons open )?database licen[cs]e (?:version |v ?)?1 0
odbl       database  0.6  open (?:data commons open )?database licen[cs]e
odc-by     commons   0.9  open data commons attribution licen[cs]e
pddl       commons   0.9  open data commons public domain dedication and licen[cs]e
ogl        government 0.9 open government licen[cs]e(?: v(?:ersion )?[123] 0)?
cc0        cc0       0.9  cc0 1 0(?: universal)?
cc0        cc0       0.6  cc0
cc0        zero      0.9  creative commons zero(?: 1 0)?
cc-by-nc-nd attribution 1.0 licen[cs]ed under (?:a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? [1-4] [05]
cc-by-nc-nd attribution 0.9 (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-nd nd       0.9  cc by nc nd(?: licen[cs]e)? [1-4] [05]
cc-by-nc-nd nd       0.6  cc by nc nd
cc-by-nc-sa attribution 1.0 licen[cs]ed under (?:a )?creative commons attribution non ?commercial share ?alike [1-4] [05]
cc-by-nc-sa attribution 0.9 (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-sa sa       0.9  cc by nc sa(?: licen[cs]e)? [1-4] [05]
cc-by-nc-sa sa       0.6  cc by nc sa
cc-by-nc   attribution 1.0  licen[cs]ed under (?:a )?creative commons attribution non ?commercial [1-4] [05]
cc-by-nc   attribution 0.9  (?:creative commons )?attribution non ?commercial(?: [1-4] [05])?
cc-by-nc   nc        0.9  cc by nc(?: licen[cs]e)? [1-4] [05]
cc-by-nc   nc        0.6  cc by nc
cc-by-nd   attribution 0.9  (?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nd   nd        0.9  cc by nd(?: licen[cs]e)? [1-4] [05]
cc-by-nd   nd        0.6  cc by nd
cc-by-sa   attribution 1.0  licen[cs]ed under (?:a )?creative commons attribution share ?alike [1-4] [05]
cc-by-sa   attribution 0.9  (?:creative commons )?attribution share ?alike(?: [1-4] [05])?
cc-by-sa   sa        0.9  cc by sa(?: licen[cs]e)? [1-4] [05]
cc-by-sa   sa        0.6  cc by sa
cc-by      commons   1.0  licen[cs]ed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e
cc-by      commons   0.9  creative commons attribution [1-4] [05]
cc-by      commons   0.6  creative commons attribution
cc-by      cc        1.0  licen[cs]ed under (?:the )?cc by(?: [1-4] [05])?
cc-by      cc        0.9  cc by(?: licen[cs]e)? [1-4] [05]
cc-by      cc        0.6  cc by
cc-any     commons   1.0  licen[cs]ed under (?:a |the )?creative commons licen[cs]e
cc-any     commons   0.6  creative commons
public-domain domain 1.0  (?:dedicated|released|placed) (?:to|into|in) the public domain
public-domain domain 0.9  this work is in the public domain
public-domain domain 0.6  public domain
public-domain waived 0.9  waived all copyright and related or neighboring rights

# No license
proprietary confidential 1.0 proprietary and confidential(?: information)?
proprietary confidential 1.0 confidential and proprietary(?: information)?
proprietary unauthorized 0.9 unauthorized (?:copying|reproduction|use|distribution)(?: of this file)?(?: via any medium)? is (?:strictly )?prohibited
proprietary prior     0.9 without (?:the )?(?:express )?prior written (?:permission|consent)
proprietary trade     0.6 trade secrets? of
proprietary eula      0.6 end user licen[cs]e agreement eula
proprietary user      0.6 end user licen[cs]e agreement
proprietary evaluation 0.6 for evaluation purposes only
non-commercial commercial 0.9 for non commercial (?:use|purposes) only
non-commercial noncommercial 0.9 for noncommercial (?:use|purposes) only
non-commercial commercial 0.9 not for commercial (?:use|purposes|distribution)
non-commercial research 0.9 for research (?:use|purposes) only
non-commercial personal 0.9 for personal use only
copyright  copyright 0.6  copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
copyright  copyrighted 0.6 copyrighted (?:material|work)s?
no-warranty warranty 0.6  without (?:warranty of any kind|any warranty)
no-warranty merchantability 0.6 merchantability (?:or|and) fitness for a particular purpose
no-warranty liable    0.6 in no event shall the (?:authors?|copyright holders?|copyright owner|regents)(?: or (?:contributors|copyright holders))? be liable
"""


def rules() -> list[tuple[str, str, str, float, bool]]:
    """(label, keyword, regex over words, weight, is a base phrase), in order of priority; the base phrases are last."""
    rows = [x.split(None, 3) for x in RULES.splitlines() if x and not x.startswith("#")]
    out = [(label, keyword, rx, float(weight), False) for label, keyword, weight, rx in rows]
    return out + [(label, phrase.split()[0], phrase, 0.6, True) for phrase, label in BASE.items()]
