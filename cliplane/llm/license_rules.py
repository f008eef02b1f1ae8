"""Rules of the licence scan, each on a line: priority, label, keywords, regex.

A regex is over lower-case words one space apart, and matches whole words; its groups
take no captures. Each of its matches holds at least one of the rule's keywords as a word.
Priority 4 is a sentence of a licence's own text, 3 a name with its version, 2 a name
or address, 1 a notice that names no licence.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    priority: int
    label: str
    keywords: tuple[str, ...]
    regex: str


# The phrases that every scan reports, with the priorities that they have among the others.
BASE = """
2 cc-by cc cc by
2 gpl public general public license
1 reserved reserved all rights reserved
"""

RULES = """
4 apache-2.0 apache licensed under the apache license version 2 0
4 apache-2.0 apache you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
4 apache-2.0 sublicense perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute
3 apache-2.0 apache apache (?:software )?licen[cs]e,? (?:version |v )?2(?: 0)?
3 apache-2.0 apache apache (?:license )?v2(?: 0)?
3 apache-2.0 apache apache 2(?: 0)?(?: licen[cs]ed?)?
3 apache-2.0 apache apache org licenses license 2 0(?: txt| html)?
3 apache-1.1 apache apache (?:software )?licen[cs]e (?:version |v )?1 1
3 apache-1.0 apache apache (?:software )?licen[cs]e (?:version |v )?1 0
2 apache apache apache (?:software |public )?licen[cs]e
2 apache apache apache lizenz
2 apache apache (?:licence|licencia|licença) apache
4 mit permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
4 mit sublicense use copy modify merge publish distribute sublicense and or sell copies of the software
4 mit substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
3 mit released released under the mit licen[cs]e
3 mit licensed licensed under the (?:terms of the )?mit licen[cs]e
3 mit opensource opensource org licenses mit(?: license)?(?: php)?
2 mit license,licence (?:the )?mit(?: x11| expat)? licen[cs]e
2 mit lizenz mit lizenz
2 mit licencia,licence,licença (?:licencia|licence|licença) mit
2 mit expat expat licen[cs]e
3 mit-0 attribution mit no attribution
3 mit-0 mit mit 0 licen[cs]e
2 x11 x11 x11 licen[cs]e
4 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
4 bsd redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
4 bsd redistributions redistributions in binary form must reproduce the above copyright notice
4 bsd-3-clause endorse neither the name of .{1,80} nor the names of (?:its|the) contributors may be used to endorse or promote products
4 bsd-4-clause acknowledgement,acknowledgment all advertising materials mentioning features or use of this software must display the following acknowled?ge?ment
4 bsd-0-clause permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
3 bsd-2-clause bsd bsd (?:2|two) clause(?: licen[cs]e)?
3 bsd-2-clause bsd (?:simplified|freebsd) bsd(?: licen[cs]e)?
3 bsd-3-clause bsd bsd (?:3|three) clause(?: licen[cs]e)?
3 bsd-3-clause bsd (?:new|modified|revised) bsd(?: licen[cs]e)?
3 bsd-4-clause bsd bsd (?:4|four) clause(?: licen[cs]e)?
3 bsd-4-clause bsd original bsd(?: licen[cs]e)?
3 bsd-0-clause 0bsd 0bsd
3 bsd-0-clause bsd (?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
3 bsd-2-clause clause (?:2|two) clause bsd(?: licen[cs]e)?
3 bsd-3-clause clause (?:3|three) clause bsd(?: licen[cs]e)?
2 bsd bsd bsd(?: style)? licen[cs]e
2 bsd bsd bsd lizenz
2 bsd bsd (?:licencia|licence|licença) bsd
4 isc permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
2 isc isc isc licen[cs]e
4 zlib misrepresented the origin of this software must not be misrepresented
4 zlib altered altered source versions must be plainly marked as such
2 zlib zlib zlib(?: libpng)? licen[cs]e
2 libpng libpng libpng licen[cs]e
4 gpl redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
4 gpl gnu you should have received a copy of the gnu general public license along with this (?:program|software|library)
4 gpl merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
3 gpl-3.0 gnu gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )?3(?: 0)?
3 gpl-3.0 public general public license (?:version |v )3(?: 0)?
3 gpl-2.0 gnu gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v )?2(?: 0)?
3 gpl-2.0 public general public license (?:version |v )2(?: 0)?
3 gpl-1.0 gnu gnu general public license (?:version |v )?1(?: 0)?
3 gpl-3.0 gpl (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: only)?
3 gpl-3.0 gplv3 (?:gnu )?gplv3
3 gpl-3.0-or-later gpl (?:gnu )?gpl (?:version |v )?3(?: 0)? or(?: any)? later
3 gpl-3.0-or-later gplv3 (?:gnu )?gplv3 or(?: any)? later
3 gpl-2.0 gpl (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: only)?
3 gpl-2.0 gplv2 (?:gnu )?gplv2
3 gpl-2.0-or-later gpl (?:gnu )?gpl (?:version |v )?2(?: 0)? or(?: any)? later
3 gpl-2.0-or-later gplv2 (?:gnu )?gplv2 or(?: any)? later
3 gpl-3.0 gnu gnu org licenses gpl 3 0(?: html| txt| en html)?
3 gpl-2.0 gnu gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
2 gpl gnu gnu general public licen[cs]e
2 gpl gnu gnu org (?:licenses|copyleft) gpl(?: html)?
2 gpl gpl (?:gnu )?gpl(?: licen[cs]ed?)?
2 gpl gnu (?:licence publique générale|licencia pública general|licença pública geral)(?: de)? gnu
2 gpl publique licence publique générale
2 gpl pública (?:licencia pública general|licença pública geral)
2 gpl lizenz allgemeine öffentliche gnu lizenz
3 gpl-exception exception gpl (?:with )?(?:linking|classpath|font|runtime library) exception
3 classpath-exception classpath classpath exception(?: 2 0)?
3 bison-exception bison bison exception
4 lgpl redistribute you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
4 lgpl lesser you should have received a copy of the gnu lesser general public license
3 lgpl-3.0 lesser (?:gnu )?lesser general public license (?:version |v )?3(?: 0)?
3 lgpl-2.1 lesser (?:gnu )?lesser general public license (?:version |v )?2 1
3 lgpl-2.0 library (?:gnu )?library general public license (?:version |v )?2(?: 0)?
3 lgpl-3.0 lgpl (?:gnu )?lgpl (?:version |v )?3(?: 0)?
3 lgpl-2.1 lgpl (?:gnu )?lgpl (?:version |v )?2 1
3 lgpl-2.0 lgpl (?:gnu )?lgpl (?:version |v )?2 0
3 lgpl-3.0 lgplv3 lgplv3
3 lgpl-2.1 lgplv2 lgplv2(?: 1)?
2 lgpl lesser (?:gnu )?lesser general public licen[cs]e
2 lgpl library (?:gnu )?library general public licen[cs]e
2 lgpl lgpl lgpl
4 agpl affero under the terms of the gnu affero general public license as published by the free software foundation
3 agpl-3.0 affero (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
3 agpl-1.0 affero affero general public license (?:version |v )?1(?: 0)?
3 agpl-3.0 agpl (?:gnu )?agpl (?:version |v )?3(?: 0)?
3 agpl-3.0 agplv3 agplv3
2 agpl affero (?:gnu )?affero general public licen[cs]e
2 agpl agpl agpl
4 gfdl documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
3 gfdl-1.3 documentation (?:gnu )?free documentation license (?:version |v )?1 3
3 gfdl-1.2 documentation (?:gnu )?free documentation license (?:version |v )?1 2
2 gfdl documentation (?:gnu )?free documentation licen[cs]e
2 gfdl gfdl gfdl
4 mpl-2.0 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
4 mpl-2.0 mozilla if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
3 mpl-2.0 mozilla mozilla public licen[cs]e (?:version |v )?2(?: 0)?
3 mpl-1.1 mozilla mozilla public licen[cs]e (?:version |v )?1 1
3 mpl-1.0 mozilla mozilla public licen[cs]e (?:version |v )?1 0
3 mpl-2.0 mpl mpl (?:version |v )?2(?: 0)?
3 mpl-1.1 mpl mpl (?:version |v )?1 1
2 mpl mozilla mozilla public licen[cs]e
3 epl-2.0 eclipse eclipse public licen[cs]e (?:version |v )?2(?: 0)?
3 epl-1.0 eclipse eclipse public licen[cs]e (?:version |v )?1(?: 0)?
3 epl-2.0 epl epl (?:version |v )?2 0
3 epl-1.0 epl epl (?:version |v )?1 0
2 epl eclipse eclipse public licen[cs]e
3 edl-1.0 eclipse eclipse distribution licen[cs]e (?:version |v )?1 0
3 cddl-1.1 cddl,distribution (?:common development and distribution licen[cs]e|cddl) (?:version |v )?1 1
3 cddl-1.0 cddl,distribution (?:common development and distribution licen[cs]e|cddl) (?:version |v )?1 0
2 cddl distribution common development and distribution licen[cs]e
2 cddl cddl cddl
3 cpl-1.0 common common public licen[cs]e (?:version |v )?1 0
2 cpl common common public licen[cs]e
2 ipl-1.0 ibm ibm public licen[cs]e
4 cc-by-4.0 licensed licensed under (?:a )?(?:the )?creative commons attribution 4 0 international licen[cs]e
4 cc licensed (?:this|the) work is licensed under (?:a|the) creative commons
3 cc-by-4.0 cc cc by 4(?: 0)?
3 cc-by-3.0 cc cc by 3(?: 0)?
3 cc-by-2.5 cc cc by 2 5
3 cc-by-2.0 cc cc by 2 0
3 cc-by-sa-4.0 cc cc by sa 4(?: 0)?
3 cc-by-sa-3.0 cc cc by sa 3(?: 0)?
3 cc-by-sa-2.5 cc cc by sa 2 5
3 cc-by-sa-2.0 cc cc by sa 2 0
3 cc-by-nd-4.0 cc cc by nd 4(?: 0)?
3 cc-by-nd-3.0 cc cc by nd 3(?: 0)?
3 cc-by-nc-4.0 cc cc by nc 4(?: 0)?
3 cc-by-nc-3.0 cc cc by nc 3(?: 0)?
3 cc-by-nc-2.0 cc cc by nc 2 0
3 cc-by-nc-sa-4.0 cc cc by nc sa 4(?: 0)?
3 cc-by-nc-sa-3.0 cc cc by nc sa 3(?: 0)?
3 cc-by-nc-sa-2.0 cc cc by nc sa 2 0
3 cc-by-nc-nd-4.0 cc cc by nc nd 4(?: 0)?
3 cc-by-nc-nd-3.0 cc cc by nc nd 3(?: 0)?
2 cc-by-sa cc cc by sa
2 cc-by-nd cc cc by nd
2 cc-by-nc cc cc by nc
2 cc-by-nc-sa cc cc by nc sa
2 cc-by-nc-nd cc cc by nc nd
3 cc0-1.0 cc0 cc0(?: 1 0)?(?: universal)?
3 cc0-1.0 zero creative commons zero(?: v?1 0)?
3 cc0-1.0 creativecommons creativecommons org publicdomain zero 1 0
3 cc-pdm-1.0 creativecommons creativecommons org publicdomain mark 1 0
3 cc-by creativecommons creativecommons org licenses by(?: [1-4] [05])?
3 cc-by-sa creativecommons creativecommons org licenses by sa(?: [1-4] [05])?
3 cc-by-nd creativecommons creativecommons org licenses by nd(?: [1-4] [05])?
3 cc-by-nc creativecommons creativecommons org licenses by nc(?: [1-4] [05])?
3 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa(?: [1-4] [05])?
3 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd(?: [1-4] [05])?
3 cc-by attribution creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?
3 cc-by-sa sharealike,share creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?
3 cc-by-nd attribution creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?
3 cc-by-nc attribution creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?
3 cc-by-nc-sa attribution creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?
3 cc-by-nc-nd attribution creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?
3 cc-by namensnennung namensnennung(?: [1-4] [05])?(?: international)?
3 cc-by-sa weitergabe namensnennung weitergabe unter gleichen bedingungen(?: [1-4] [05])?
3 cc-by paternité paternité(?: [1-4] [05])?
3 cc-by-sa reconocimiento reconocimiento compartir ?igual(?: [1-4] [05])?
2 cc commons creative commons
2 public-domain public (?:released|placed|dedicated) (?:in|into|to) the public domain
4 unlicense unencumbered this is free and unencumbered software released into the public domain
2 unlicense unlicense (?:the )?unlicense(?: org)?
2 public-domain gemeinfrei gemeinfrei
2 public-domain domaine domaine public
2 public-domain dominio dominio público
4 wtfpl fuck you just do what the fuck you want to
2 wtfpl wtfpl wtfpl
2 wtfpl fuck do what the fuck you want to public licen[cs]e
3 artistic-2.0 artistic artistic licen[cs]e (?:version |v )?2(?: 0)?
3 artistic-1.0 artistic artistic licen[cs]e (?:version |v )?1(?: 0)?
2 artistic artistic artistic licen[cs]e
2 perl perl same terms as perl(?: itself)?
3 boost-1.0 boost boost software licen[cs]e (?:version )?1 0
3 boost-1.0 bsl bsl 1 0
2 boost boost boost software licen[cs]e
4 openssl openssl this product includes software developed by the openssl project
2 openssl openssl openssl licen[cs]e
2 ssleay ssleay ssleay licen[cs]e
3 python-2.0 psf,python (?:psf|python software foundation) licen[cs]e (?:version |v )?2(?: 0)?
2 python psf,python (?:psf|python software foundation|python) licen[cs]e
3 php-3.01 php php licen[cs]e (?:version |v )?3 0?1
2 php php php licen[cs]e
2 ruby ruby ruby licen[cs]e
2 postgresql postgresql postgresql licen[cs]e
2 ncsa ncsa (?:university of illinois )?ncsa(?: open source)? licen[cs]e
3 w3c w3c w3c (?:software|document)(?: and document)?(?: notice and)? licen[cs]e
3 unicode unicode unicode (?:inc )?licen[cs]e(?: agreement)?
3 ofl-1.1 sil sil open font licen[cs]e (?:version |v )?1 1
2 ofl font (?:sil )?open font licen[cs]e
2 ofl ofl ofl
3 afl-3.0 academic academic free licen[cs]e (?:version |v )?3 0
2 afl academic academic free licen[cs]e
3 osl-3.0 open open software licen[cs]e (?:version |v )?3 0
2 osl software open software licen[cs]e
3 eupl-1.2 eupl,union (?:european union public licen[cs]e|eupl) (?:version |v )?1 2
3 eupl-1.1 eupl,union (?:european union public licen[cs]e|eupl) (?:version |v )?1 1
2 eupl eupl,union european union public licen[cs]e
2 eupl eupl eupl
3 cecill-2.1 cecill cecill (?:version |v )?2 1
2 cecill cecill (?:licence )?cecill(?: [bc])?
2 ms-pl microsoft microsoft public licen[cs]e
2 ms-rl microsoft microsoft reciprocal licen[cs]e
2 ms-pl ms ms pl
2 ms-rl ms ms rl
3 odbl-1.0 odbl,database (?:open (?:data commons )?database licen[cs]e|odbl)(?: version| v)?(?: 1 0)?
2 odc-by odc odc by(?: 1 0)?
2 pddl pddl,dedication (?:public domain dedication and licen[cs]e|pddl)
3 sspl-1.0 sspl,side (?:server side public licen[cs]e|sspl)(?: version| v)?(?: 1)?(?: 0)?
3 busl-1.1 business business source licen[cs]e (?:version )?1 1
2 busl business business source licen[cs]e
2 busl busl busl(?: 1 1)?
3 elastic-2.0 elastic elastic licen[cs]e (?:version |v )?2(?: 0)?
2 elastic elastic elastic licen[cs]e
2 commons-clause clause commons clause
3 polyform-nc polyform polyform noncommercial(?: licen[cs]e)?(?: 1 0 0)?
2 polyform polyform polyform
2 beerware beerware beerware
4 beerware beer you can buy me a beer in return
2 json-license evil the software shall be used for good not evil
2 vim vim vim licen[cs]e
2 tcl tcl tcl(?: tk)? licen[cs]e
2 curl curl curl licen[cs]e
2 icu icu icu licen[cs]e
2 ijg jpeg independent jpeg group
2 freetype freetype freetype (?:project )?licen[cs]e
2 imagemagick imagemagick imagemagick licen[cs]e
2 sleepycat sleepycat sleepycat licen[cs]e
2 zpl zope zope public licen[cs]e(?: version| v)?(?: 2 [01])?
2 qpl qpl,q (?:q public licen[cs]e|qpl)
2 lppl latex,lppl (?:latex project public licen[cs]e|lppl)(?: v?1 3c?)?
2 naumen naumen naumen public licen[cs]e
2 motosoto motosoto motosoto(?: open source)? licen[cs]e
2 rpl reciprocal reciprocal public licen[cs]e(?: 1 [15])?
2 upl permissive universal permissive licen[cs]e(?: v?1 0)?
2 mulan-psl mulan mulan (?:permissive software licen[cs]e|psl)(?: v?2)?
2 blueoak blue blue oak model licen[cs]e(?: 1 0 0)?
2 hippocratic hippocratic hippocratic licen[cs]e
2 openrail openrail,rail (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?
2 llama llama llama (?:[234] )?community licen[cs]e
3 spdx spdx spdx licen[cs]e identifier [a-z0-9]+
1 spdx spdx spdx licen[cs]e list
1 copyright copyright copyright (?:c )?(?:[0-9]{4} ){0,4}[0-9]{4}
1 copyright copyright (?:©|c) copyright
1 copyright © © [0-9]{4}
1 copyright copyrighted copyrighted (?:material|work)
1 reserved reserved some rights reserved
1 reserved reserved no rights reserved
1 reserved vorbehalten alle rechte vorbehalten
1 reserved droits tous droits réservés
1 reserved derechos (?:todos )?los derechos reservados
1 reserved derechos todos los derechos reservados
1 reserved direitos todos os direitos reservados
1 reserved diritti tutti i diritti riservati
1 copyright urheberrechtlich urheberrechtlich geschützt
1 copyright auteur droits? d auteur
1 copyright autor derechos? de autor
1 proprietary proprietary proprietary (?:and confidential|software|licen[cs]e|information)
1 confidential confidential confidential and proprietary
1 no-redistribution redistributed may not be (?:copied|reproduced|published) (?:or )?(?:broadcast )?(?:rewritten )?or redistributed
1 no-redistribution permission (?:may|must) not be reproduced (?:or )?(?:distributed )?without (?:the )?(?:prior )?(?:express )?(?:written )?permission
1 no-redistribution unauthorized unauthorized (?:use|copying|reproduction|distribution)(?: or (?:use|copying|reproduction|distribution))? is (?:strictly )?prohibited
1 no-commercial commercial,noncommercial (?:for )?non ?commercial use only
1 warranty warranty provided as is without (?:any )?warrant(?:y|ies) of any kind
1 license-notice licensed licensed under the [a-z0-9]+(?: [a-z0-9]+)? licen[cs]e
1 license-notice licensed licensed under (?:the )?terms of
1 license-notice license see (?:the )?license(?: md| txt| file)? (?:file )?for (?:the full )?(?:details|license text|licensing information)
1 license-notice lizenz unter (?:der|einer) [a-z0-9]+ lizenz
1 license-notice licence sous licence [a-z0-9]+
1 license-notice licencia bajo (?:la )?licencia [a-z0-9]+
1 license-notice released released under (?:the )?(?:an )?open source licen[cs]e
1 dual-license dual dual licen[cs](?:ed|ing)
"""


def read(text: str) -> list[Rule]:
    found = [line.split(" ", 3) for line in text.strip().splitlines()]
    return [Rule(int(p), label, tuple(keys.split(",")), regex) for p, label, keys, regex in found]
