"""License signatures, written by hand, in order.

A line holds a label, a priority (4: a tag or a full name with version; 3: a sentence of one license; 2: a family; 1: a
hint), a keyword that every match contains, and a regular expression over words in lower case with one space between.
"""

RULES = """
gpl-3.0-or-later    4 | spdx       | spdx license identifier a?gpl 3 0 or later
gpl-3.0             4 | spdx       | spdx license identifier gpl 3 0( only)?
gpl-2.0-or-later    4 | spdx       | spdx license identifier gpl 2 0 or later
gpl-2.0             4 | spdx       | spdx license identifier gpl 2 0( only)?
lgpl-3.0            4 | spdx       | spdx license identifier lgpl 3 0( only| or later)?
lgpl-2.1            4 | spdx       | spdx license identifier lgpl 2 1( only| or later)?
lgpl-2.0            4 | spdx       | spdx license identifier lgpl 2 0( only| or later)?
agpl-3.0            4 | spdx       | spdx license identifier agpl 3 0( only| or later)?
mit                 4 | spdx       | spdx license identifier mit
mit-0               4 | spdx       | spdx license identifier mit 0
apache-2.0          4 | spdx       | spdx license identifier apache 2 0
apache-1.1          4 | spdx       | spdx license identifier apache 1 1
bsd-2-clause        4 | spdx       | spdx license identifier bsd 2 clause
bsd-3-clause        4 | spdx       | spdx license identifier bsd 3 clause
bsd-4-clause        4 | spdx       | spdx license identifier bsd 4 clause
0bsd                4 | spdx       | spdx license identifier 0bsd
isc                 4 | spdx       | spdx license identifier isc
mpl-2.0             4 | spdx       | spdx license identifier mpl 2 0
mpl-1.1             4 | spdx       | spdx license identifier mpl 1 1
epl-2.0             4 | spdx       | spdx license identifier epl 2 0
epl-1.0             4 | spdx       | spdx license identifier epl 1 0
cddl-1.0            4 | spdx       | spdx license identifier cddl 1 [01]
cc0-1.0             4 | spdx       | spdx license identifier cc0 1 0
cc-by               4 | spdx       | spdx license identifier cc by [1234] [05]
cc-by-sa            4 | spdx       | spdx license identifier cc by sa [1234] [05]
unlicense           4 | spdx       | spdx license identifier unlicense
zlib                4 | spdx       | spdx license identifier zlib
bsl-1.0             4 | spdx       | spdx license identifier bsl 1 0
wtfpl               4 | spdx       | spdx license identifier wtfpl
artistic-2.0        4 | spdx       | spdx license identifier artistic 2 0
eupl-1.2            4 | spdx       | spdx license identifier eupl 1 2
ofl-1.1             4 | spdx       | spdx license identifier ofl 1 1
spdx-other          2 | spdx       | spdx license identifier [0-9a-z]+
apache-2.0          4 | licen      | apache license( version)? 2( 0)?
apache-2.0          4 | licen      | licensed under the apache license( version)? 2 0
apache-2.0          3 | licen      | www apache org licenses license 2 0( txt| html)?
apache-2.0          3 | licen      | apache 2( 0)? licensed?
apache-2.0          3 | licen      | unless required by applicable law or agreed to in writing software distributed under the license
apache-1.1          4 | licen      | apache( software)? license( version)? 1 1
apache-1.0          4 | licen      | apache( software)? license( version)? 1 0
apache              2 | licen      | apache( software)? license
apache              2 | licen      | apache software foundation license
mit                 4 | licen      | mit license
mit                 4 | licen      | licensed under the( terms of the)? mit license
mit                 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit                 3 | copies     | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit                 2 | licen      | expat license
mit                 2 | licen      | mit licensed
mit                 2 | licen      | licen[cs]e mit
x11                 3 | licen      | x11 license
x11                 3 | licen      | mit x11( style)? license
mit-0               4 | attribution| mit no attribution( license)?
bsd-2-clause        4 | bsd        | bsd 2 clause( simplified)?( license)?
bsd-2-clause        4 | licen      | (simplified|freebsd) (bsd )?license
bsd-2-clause        3 | bsd        | (2|two) clause bsd( license)?
bsd-3-clause        4 | bsd        | bsd 3 clause( new| revised)?( license)?
bsd-3-clause        4 | bsd        | (new|revised|modified) bsd( license)?
bsd-3-clause        3 | bsd        | (3|three) clause bsd( license)?
bsd-3-clause        3 | endorse    | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause        4 | bsd        | bsd 4 clause( original| old)?( license)?
bsd-4-clause        3 | advertis   | all advertising materials mentioning features or use of this software must display
bsd-4-clause        3 | bsd        | (4|four) clause bsd( license)?
bsd                 2 | licen      | bsd( style)? license
bsd                 3 | redistribut| redistribution and use in source and binary forms with or without modification are permitted
bsd                 2 | redistribut| redistributions of source code must retain the above copyright notice
bsd                 2 | redistribut| redistributions in binary form must reproduce the above copyright notice
0bsd                4 | bsd        | (0|zero) clause bsd( license)?
0bsd                4 | licen      | bsd zero clause license
isc                 4 | licen      | isc license
isc                 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc                 3 | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
gpl-3.0-or-later    4 | licen      | gnu general public license( as published by the free software foundation)? either version 3( of the license)? or( at your option)? any later version
gpl-2.0-or-later    4 | licen      | gnu general public license( as published by the free software foundation)? either version 2( of the license)? or( at your option)? any later version
gpl-3.0             4 | licen      | (gnu )?general public license( version| v)? (3|v3)( 0)?
gpl-2.0             4 | licen      | (gnu )?general public license( version| v)? (2|v2)( 0)?
gpl-1.0             4 | licen      | (gnu )?general public license( version| v)? (1|v1)( 0)?
gpl-3.0             4 | gpl        | gpl ?v?3( 0)?
gpl-2.0             4 | gpl        | gpl ?v?2( 0)?
gpl-3.0             3 | gpl        | gpl version 3
gpl-2.0             3 | gpl        | gpl version 2
gpl                 3 | licen      | (gnu )?general public license
gpl                 2 | gpl        | gnu gpl
gpl                 2 | licen      | gpl licen[cs]ed?
gpl                 2 | licen      | licensed under the gpl
gpl                 1 | redistribut| this program is free software you can redistribute it and or modify it
gpl                 1 | warrant    | without even the implied warranty of merchantability or fitness for a particular purpose
gpl                 1 | licen      | you should have received a copy of the gnu general public license
gpl-exception       3 | exception  | (classpath|linking|autoconf|bison|runtime library|font) exception
lgpl-3.0            4 | licen      | (gnu )?lesser general public license( version| v)? (3|v3)( 0)?
lgpl-2.1            4 | licen      | (gnu )?lesser general public license( version| v)? (2|v2) 1
lgpl-2.0            4 | licen      | (gnu )?library general public license( version| v)? (2|v2)( 0)?
lgpl-3.0            4 | lgpl       | lgpl ?v?3( 0)?
lgpl-2.1            4 | lgpl       | lgpl ?v?2 1
lgpl-2.0            4 | lgpl       | lgpl ?v?2( 0)?
lgpl                3 | licen      | (gnu )?(lesser|library) general public license
lgpl                2 | lgpl       | gnu lgpl
lgpl                2 | licen      | lgpl licen[cs]ed?
agpl-3.0            4 | licen      | (gnu )?affero general public license( version| v)? (3|v3)( 0)?
agpl-3.0            4 | agpl       | agpl ?v?3( 0)?
agpl-1.0            4 | licen      | affero general public license( version| v)? (1|v1)( 0)?
agpl                3 | licen      | (gnu )?affero general public license
agpl                2 | licen      | agpl licen[cs]ed?
gfdl-1.3            4 | licen      | (gnu )?free documentation license( version| v)? 1 3
gfdl-1.2            4 | licen      | (gnu )?free documentation license( version| v)? 1 2
gfdl-1.1            4 | licen      | (gnu )?free documentation license( version| v)? 1 1
gfdl                3 | licen      | (gnu )?free documentation license
gfdl                2 | fdl        | gnu fdl|gfdl
mpl-2.0             4 | licen      | mozilla public license( version| v)? (2|v2)( 0)?
mpl-1.1             4 | licen      | mozilla public license( version| v)? 1 1
mpl-1.0             4 | licen      | mozilla public license( version| v)? 1 0
mpl-2.0             3 | mozilla    | mozilla org mpl 2 0
mpl                 3 | licen      | mozilla public license
mpl-2.0             3 | mpl        | mpl 2 0
mpl-1.1             3 | mpl        | mpl 1 1
npl-1.1             4 | licen      | netscape public license( version| v)? 1 1
npl                 3 | licen      | netscape public license
epl-2.0             4 | licen      | eclipse public license( version| v)? (2|v2)( 0)?
epl-1.0             4 | licen      | eclipse public license( version| v)? (1|v1)( 0)?
epl                 3 | licen      | eclipse public license
edl-1.0             3 | licen      | eclipse distribution license
cpl-1.0             3 | licen      | common public license( version| v)?( 1 0)?
ipl-1.0             3 | licen      | ibm public license( version| v)?( 1 0)?
cddl-1.1            4 | licen      | common development and distribution license( cddl)?( version| v)? 1 1
cddl-1.0            4 | licen      | common development and distribution license( cddl)?( version| v)? 1 0
cddl                3 | licen      | common development and distribution license
cddl                2 | cddl       | cddl( version| v)?( 1 [01])?
cpal-1.0            3 | licen      | common public attribution license
eupl-1.2            4 | licen      | european union public licen[cs]e( eupl)?( version| v)? ?1 2
eupl-1.1            4 | licen      | european union public licen[cs]e( eupl)?( version| v)? ?1 1
eupl                3 | licen      | european union public licen[cs]e
cecill-2.1          4 | cecill     | cecill( free software license agreement)?( version| v)? 2 1
cecill-b            4 | cecill     | cecill b
cecill-c            4 | cecill     | cecill c
cecill              2 | cecill     | cecill
artistic-2.0        4 | licen      | artistic license( version| v)? 2( 0)?
artistic-1.0        4 | licen      | artistic license( version| v)? 1( 0)?
artistic            3 | licen      | (perl )?artistic license
perl                3 | perl       | same terms as perl( itself)?
python-2.0          3 | licen      | python( software foundation)? license( version| agreement)?( 2)?
psf                 2 | licen      | psf license
ruby                3 | licen      | ruby( s)? license
php-3.01            4 | licen      | php license( version| v)? 3 01
php-3.0             4 | licen      | php license( version| v)? 3 0
php                 3 | licen      | php license
zlib                3 | licen      | zlib( libpng)? license
zlib                3 | freely     | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
libpng              3 | licen      | libpng license
libtiff             3 | licen      | libtiff license
ijg                 3 | jpeg       | independent jpeg group
ftl                 3 | freetype   | freetype( project)? license
bsl-1.0             4 | licen      | boost software license( version| v)?( 1 0)?
busl-1.1            4 | licen      | business source license( version| v)?( 1 1)?
sspl-1.0            4 | licen      | server side public license( version| v)?( 1)?
elastic-2.0         4 | licen      | elastic license( version| v)?( 2 0)?
unlicense           4 | domain     | this is free and unencumbered software released into the public domain
unlicense           3 | unlicense  | (the )?unlicense
wtfpl               4 | licen      | do what the fuck you want to public license
wtfpl               3 | wtfpl      | wtfpl
beerware            3 | beer       | beer ?ware( license)?
vim                 3 | licen      | vim license
openssl             3 | licen      | openssl license
ssleay              3 | ssleay     | original ssleay license|ssleay license
sleepycat           3 | licen      | sleepycat( public)? license
postgresql          3 | licen      | postgresql licen[cs]e
ncsa                3 | licen      | (university of illinois|uiuc|ncsa)( open source)? license
json                3 | evil       | the software shall be used for good not evil
curl                3 | licen      | curl license
icu                 3 | licen      | icu license
unicode             3 | licen      | unicode( inc)? license( agreement)?
w3c                 3 | licen      | w3c software( notice)?( and document)? license
naist               2 | licen      | naist license
tcl                 3 | licen      | tcl( tk)? license
intel               2 | licen      | intel( simplified)?( open source)? (software )?license
nvidia              2 | licen      | nvidia( software| cuda)? license( agreement)?
ms-pl               4 | licen      | microsoft public license( ms pl)?
ms-rl               4 | licen      | microsoft reciprocal license( ms rl)?
ms-eula             2 | licen      | microsoft software license terms
apsl-2.0            4 | licen      | apple public source license( version| v)?( 2 0)?
osl-3.0             4 | licen      | open software license( version| v)?( 3 0)?
afl-3.0             4 | licen      | academic free license( version| v)?( 3 0)?
ecl-2.0             4 | licen      | educational community license( version| v)?( 2 0)?
qpl-1.0             3 | licen      | q public license( version| v)?( 1 0)?
lppl-1.3            4 | licen      | latex project public license( version| v)?( 1 3[abc]?)?
ofl-1.1             4 | licen      | (sil )?open font license( version| v)?( 1 1)?
upl-1.0             4 | licen      | universal permissive license( version| v)?( 1 0)?
odbl-1.0            4 | licen      | open (data commons open )?database license( odbl)?( v1 0| 1 0)?
odc-by-1.0          4 | licen      | open data commons attribution license
pddl-1.0            4 | licen      | open data commons public domain dedication( and)? license
ogl-3.0             4 | licen      | open government licen[cs]e( version| v)?( 3 0)?
etalab-2.0          3 | licence    | licence ouverte( open licence)?( etalab)?( 2 0)?
dl-de-by-2.0        3 | lizenz     | datenlizenz deutschland( namensnennung)?( version)?( 2 0)?
llama               3 | licen      | llama( [23])?( [0-9])? community license( agreement)?
openrail            3 | rail       | (creativeml |bigscience )?open ?rail( m| [m])?( license)?
cc0-1.0             4 | cc0        | cc0( 1 0)?( universal)?
cc0-1.0             3 | domain     | public domain dedication
cc-by-nc-nd         4 | cc         | cc by nc nd( [1234] [05])?
cc-by-nc-sa         4 | cc         | cc by nc sa( [1234] [05])?
cc-by-nc            4 | cc         | cc by nc( [1234] [05])?
cc-by-nd            4 | cc         | cc by nd( [1234] [05])?
cc-by-sa            4 | cc         | cc by sa( [1234] [05])?
cc-by               4 | cc         | cc by [1234] [05]
cc-by               3 | cc         | cc by
cc-by-nc-nd         4 | creative   | creative commons attribution non ?commercial no ?deriv(s|atives|ative works)( [1234] [05])?
cc-by-nc-sa         4 | creative   | creative commons attribution non ?commercial share ?alike( [1234] [05])?
cc-by-nc            4 | creative   | creative commons attribution non ?commercial( [1234] [05])?
cc-by-nd            4 | creative   | creative commons attribution no ?deriv(s|atives|ative works)( [1234] [05])?
cc-by-sa            4 | creative   | creative commons attribution share ?alike( [1234] [05])?
cc-by               4 | creative   | creative commons attribution( [1234] [05])?
cc-by-nc-nd         3 | creative   | creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-sa         3 | creative   | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc            3 | creative   | creativecommons org licenses by nc [1234] [05]
cc-by-nd            3 | creative   | creativecommons org licenses by nd [1234] [05]
cc-by-sa            3 | creative   | creativecommons org licenses by sa [1234] [05]
cc-by               3 | creative   | creativecommons org licenses by [1234] [05]
cc0-1.0             3 | creative   | creativecommons org publicdomain zero 1 0
cc                  2 | creative   | creative commons( license| licence)?
public-domain       3 | domain     | (is |are |released |placed |dedicated )?(in|into|to) the public domain
public-domain       2 | domain     | public domain
reserved            3 | reserved   | all rights reserved
reserved            2 | reserved   | some rights reserved
reserved            1 | reserved   | rights reserved
copyright           2 | copyright  | copyright c( [12][0-9][0-9][0-9])+
copyright           2 | copyright  | copyright [12][0-9][0-9][0-9]
copyright           1 | copyright  | copyright( c)?( by)?
proprietary         3 | proprietar | (proprietary and confidential|confidential and proprietary)
proprietary         2 | licen      | commercial license( agreement)?
proprietary         2 | licen      | end user license agreement
proprietary         2 | permission | without( the)?( express| prior)?( written)? permission of the (author|copyright holder|publisher)
proprietary         2 | redistribut| redistribution( is)? (prohibited|not permitted)
disclaimer          1 | warrant    | the software is provided as is without warranty of any kind express or implied
disclaimer          1 | warrant    | as is without( any)? (express or implied )?warrant(y|ies)
disclaimer          1 | event      | in no event shall the (authors|copyright holder|copyright owner)s?
license-reference   1 | licen      | see( the)?( file)? licen[cs]e( txt| md)? (file|for details|for more information)
license-reference   1 | licen      | licen[cs]ed under( the)?( terms of)?( the)?
license-reference   1 | licen      | this (file|work|document|dataset|content|text) is licen[cs]ed
license-reference   1 | licen      | under the terms of the license
"""
