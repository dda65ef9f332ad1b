"""Rules that tell licences by their names, notices, tags, addresses and sentences.

A rule is a regular expression over the words of a text, lower-cased and joined by one space (so "Apache-2.0" reads
"apache 2 0"). Names are written by hand once for each licence and take part in several forms: a notice
("released under the ..."), a tag ("license: ..."), a translated notice, and a bare title. Sentences of the
licences' own texts, addresses and identifiers are written in full.

Every rule has groups of keywords: whole words, of which the text must have one of each group before the expression
is tried. Priorities order the kinds: a licence's own sentence, an address, a notice, a tag, a title.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

SENTENCE, ADDRESS, NOTICE, TAG, TITLE = 5, 4, 3, 2, 1
CONFIDENCE = {SENTENCE: 0.98, ADDRESS: 0.9, NOTICE: 0.95, TAG: 0.85, TITLE: 0.5}

#: Phrases whose places are counted, and their labels; they stay whatever else is found.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = r"(?: ?v(?:ersion)?)? ?"
_LATER = r"(?: 0)?(?: or(?: at your option)?(?: any)? later(?: version)?| plus)"
_CC = r"(?:creative commons|cc)"
_BY, _NC, _ND, _SA = "(?:attribution|by)", "(?:non ?commercial|nc)", "(?:no ?deriv(?:ative)?s?|nd)", "(?:share ?alike|sa)"

#: label, one of these words must be there, the name.
NAMES = (
    ("mit", "mit expat x11", r"(?:mit|expat|x11|mit x11|mit expat)"),
    ("mit-0", "mit", r"mit (?:no attribution|0)"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: licen[sc]e)?{_V}1 1"),
    ("apache-1", "apache", rf"apache(?: software)?(?: licen[sc]e)?{_V}1 0"),
    ("apache-2", "apache asl2 apache2", rf"(?:apache(?: software)?(?: licen[sc]e)?{_V}2(?: 0)?|asl2|apache2)"),
    ("apache", "apache", r"apache(?: software)?"),
    ("bsd-0", "bsd 0bsd", r"(?:0bsd|(?:bsd )?zero clause bsd|bsd 0 clause)"),
    ("bsd-1", "bsd", r"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)"),
    ("bsd-2", "bsd freebsd", r"(?:(?:simplified|2 clause|two clause) bsd|bsd (?:2|two) clause|freebsd)"),
    ("bsd-3", "bsd", r"(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause)"),
    ("bsd-4", "bsd", r"(?:(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause)"),
    ("bsd", "bsd", r"(?:berkeley software distribution|bsd(?: style)?)"),
    ("agpl-3-or-later", "agpl agplv3 affero", rf"(?:gnu )?(?:agplv?|affero general public licen[sc]e){_V}3{_LATER}"),
    ("agpl-3", "agpl agplv3 affero", rf"(?:gnu )?(?:agplv?|affero general public licen[sc]e){_V}3(?: 0)?(?: only)?"),
    ("agpl", "agpl affero", r"(?:gnu )?(?:agpl|affero general public(?: licen[sc]e)?)"),
    ("lgpl-2.1-or-later", "lgpl lgplv2 lesser", rf"(?:gnu )?(?:lgplv?|lesser general public licen[sc]e){_V}2 1{_LATER}"),
    ("lgpl-2.1", "lgpl lgplv2 lesser", rf"(?:gnu )?(?:lgplv?|lesser general public licen[sc]e){_V}2 1(?: only)?"),
    ("lgpl-2", "lgpl lgplv2 library", rf"(?:gnu )?(?:lgplv?|library general public licen[sc]e){_V}2(?: 0)?(?: only)?"),
    ("lgpl-3-or-later", "lgpl lgplv3 lesser", rf"(?:gnu )?(?:lgplv?|lesser general public licen[sc]e){_V}3{_LATER}"),
    ("lgpl-3", "lgpl lgplv3 lesser", rf"(?:gnu )?(?:lgplv?|lesser general public licen[sc]e){_V}3(?: 0)?(?: only)?"),
    ("lgpl", "lgpl lesser", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public(?: licen[sc]e)?)"),
    ("gpl-1", "gpl gplv1 gnu", rf"(?:gnu )?(?:gplv?|general public licen[sc]e){_V}1(?: 0)?(?: only)?"),
    ("gpl-2-or-later", "gpl gplv2 gnu", rf"(?:gnu )?(?:gplv?|general public licen[sc]e){_V}2{_LATER}"),
    ("gpl-2", "gpl gplv2 gnu", rf"(?:gnu )?(?:gplv?|general public licen[sc]e){_V}2(?: 0)?(?: only)?"),
    ("gpl-3-or-later", "gpl gplv3 gnu", rf"(?:gnu )?(?:gplv?|general public licen[sc]e){_V}3{_LATER}"),
    ("gpl-3", "gpl gplv3 gnu", rf"(?:gnu )?(?:gplv?|general public licen[sc]e){_V}3(?: 0)?(?: only)?"),
    ("gpl", "gpl gnu", r"(?:gnu )?(?:gpl|general public(?: licen[sc]e)?)"),
    ("gfdl", "gfdl documentation", r"(?:gnu )?(?:gfdl|free documentation(?: licen[sc]e)?)(?: v(?:ersion)? ?\d(?: \d)?)?"),
    ("mpl-1.1", "mpl mozilla", rf"(?:mpl|mozilla public(?: licen[sc]e)?){_V}1 [01]"),
    ("mpl-2", "mpl mozilla", rf"(?:mpl|mozilla public(?: licen[sc]e)?){_V}2(?: 0)?"),
    ("mpl", "mpl mozilla", r"(?:mpl|mozilla public)"),
    ("epl-1", "epl eclipse", rf"(?:epl|eclipse public(?: licen[sc]e)?){_V}1(?: 0)?"),
    ("epl-2", "epl eclipse", rf"(?:epl|eclipse public(?: licen[sc]e)?){_V}2(?: 0)?"),
    ("edl-1", "eclipse", rf"eclipse distribution(?: licen[sc]e)?{_V}1(?: 0)?"),
    ("cddl-1", "cddl common", rf"(?:cddl|common development and distribution(?: licen[sc]e)?){_V}1 [01]"),
    ("cpl-1", "common cpl", rf"(?:cpl|common public(?: licen[sc]e)?){_V}1(?: 0)?"),
    ("eupl-1.1", "eupl european", rf"(?:eupl|european union public(?: licen[sc]e)?){_V}1 1"),
    ("eupl-1.2", "eupl european", rf"(?:eupl|european union public(?: licen[sc]e)?){_V}1 2"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)"),
    ("libpng", "libpng", r"libpng(?: 2(?: 0)?)?"),
    ("artistic-1", "artistic", rf"artistic(?: licen[sc]e)?{_V}1(?: 0)?"),
    ("artistic-2", "artistic", rf"artistic(?: licen[sc]e)?{_V}2(?: 0)?"),
    ("perl", "perl", r"(?:same terms as perl(?: itself)?|perl 5)"),
    ("python-2", "python psf", r"(?:python software foundation|psf|python)(?: licen[sc]e)?(?: v(?:ersion)?)? 2(?: 0)?"),
    ("ruby", "ruby", r"ruby"),
    ("php-3", "php", r"php(?: licen[sc]e)?(?: v(?:ersion)?)? 3(?: 0| 01)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl fuck", r"(?:wtfpl|do what the fuck you want to public(?: licen[sc]e)?)"),
    ("boost-1", "boost bsl", r"(?:boost software(?: licen[sc]e)?(?: v(?:ersion)? ?1(?: 0)?)?|bsl 1 0)"),
    ("busl-1.1", "business busl", r"(?:business source(?: licen[sc]e)?(?: v(?:ersion)?)?(?: 1 1)?|busl 1 1)"),
    ("sspl-1", "sspl server", r"(?:server side public(?: licen[sc]e)?(?: v(?:ersion)? ?1)?|sspl(?: ?v?1(?: 0)?)?)"),
    ("elastic-2", "elastic", r"elastic(?: licen[sc]e)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("ofl-1.1", "ofl sil font", r"(?:sil )?(?:ofl|open font(?: licen[sc]e)?)(?: v(?:ersion)?)?(?: 1 [01])?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa illinois", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("openssl", "openssl", r"(?:openssl|openssl ssleay)"),
    ("w3c", "w3c", r"w3c(?: software(?: notice)?(?: and document)?)?"),
    ("ms-pl", "microsoft ms", r"(?:microsoft public|ms pl)"),
    ("ms-rl", "microsoft ms", r"(?:microsoft reciprocal|ms rl)"),
    ("cecill-2", "cecill", r"cecill(?: v(?:ersion)? ?2(?: [01])?| 2(?: [01])?)?"),
    ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"),
    ("beerware", "beerware beer", r"(?:beerware|beer ware)"),
    ("odbl-1", "odbl database", r"(?:odbl|open database(?: licen[sc]e)?)(?: v(?:ersion)?)?(?: 1 0)?"),
    ("odc-by-1", "odc commons", r"(?:odc by|open data commons attribution(?: licen[sc]e)?)(?: v?1 0)?"),
    ("pddl-1", "pddl domain", r"(?:pddl|(?:odc )?public domain dedication and licen[sc]e)(?: 1 0)?"),
    ("ogl-uk-3", "ogl government", r"(?:ogl(?: uk)?|open government(?: licen[sc]e)?)(?: v(?:ersion)?)?(?: ?3(?: 0)?)?"),
    ("etalab-2", "etalab licence ouverte", r"(?:etalab(?: 2 0)?|licence ouverte(?: open licence)?)"),
    ("openrail-m", "openrail rail", r"(?:creativeml )?(?:open ?rail(?: ?m)?|bigscience rail)"),
    ("llama", "llama", r"llama(?: \d(?: \d)?)? community"),
    ("bsd-patent", "bsd", r"bsd (?:2 clause )?(?:plus )?patent"),
    ("cc-by-nc-nd", "cc creative", rf"{_CC} {_BY} {_NC} {_ND}(?: \d 0)?"),
    ("cc-by-nc-sa", "cc creative", rf"{_CC} {_BY} {_NC} {_SA}(?: \d 0)?"),
    ("cc-by-nc", "cc creative", rf"{_CC} {_BY} {_NC}(?: \d 0)?"),
    ("cc-by-nd", "cc creative", rf"{_CC} {_BY} {_ND}(?: \d 0)?"),
    ("cc-by-sa", "cc creative", rf"{_CC} {_BY} {_SA}(?: \d 0)?"),
    ("cc-by", "cc creative", rf"{_CC} {_BY}(?: \d 0)?"),
    ("cc0", "cc0 creative", r"(?:cc0(?: 1 0)?(?: universal)?|creative commons zero)"),
    ("cc", "creative", r"creative commons"),
)

_LICENSE = "license licence licenses licences licensed licenced licensing lizenz lizenziert licencia sublicense spdx"
_UNDER = (
    r"(?:re)?(?:licen[sc]ed|released|distributed|available|provided|published|covered|governed|shared|offered|issued|redistributed|usable|dual licen[sc]ed|supplied|use it|used|redistribute it(?: and or modify it)?|subject)"
    r"(?: to you| freely| for use| here| as is)?(?: under| by| with| to| according to| in accordance with)(?: either)?(?: the)?(?: terms(?: and conditions)? of)?(?: either)?(?: the| a| an| version 2 of the| version 3 of the)?"
)
_NOTICE_WORDS = "licensed licenced released distributed available provided published covered governed shared offered issued redistributed usable supplied use used redistribute subject relicensed"
_FOREIGN = (
    ("sous publié distribué", r"(?:(?:publié|distribué|diffusé|disponible|proposé)e?s? )?sous(?: la)?(?: licence)?(?: publique)?"),
    ("unter lizenz", r"(?:(?:veröffentlicht|lizenziert|verfügbar|verteilt|freigegeben) )?unter(?: den bedingungen)?(?: der| einer)?(?: lizenz)?"),
    ("bajo licencia", r"(?:(?:publicado|distribuido|licenciado|disponible|liberado)s? )?bajo(?: los términos de)?(?: la| una)?(?: licencia)?"),
)

#: label, keyword groups (";" parts groups), the licence's own words.
SENTENCES = (
    ("mit", "permission;granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "notice;copies", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "deal;restriction", r"to deal in the software without restriction (?:\w+ ){10,40}to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "x;consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "permission;fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2", "redistribution;source", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "endorse;promote", r"neither the name of (?:\w+ ){1,12}(?:nor|or) the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising;acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "compliance;license", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "perpetual;irrevocable", r"perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) license"),
    ("apache-2", "terms;reproduction", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", "apache;acknowledgment", r"this product includes software developed by the apache software foundation"),
    ("gpl-2", "gnu;1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu;2007", r"gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", "gnu;1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "gnu;2007", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "affero;2007", r"gnu affero general public license version 3 19 november 2007"),
    ("gpl-2-or-later", "gnu;later", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", "gnu;later", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu;version", r"gnu general public license (?:version 2 )?as published by the free software foundation version 2(?: of the license)?"),
    ("lgpl-2.1-or-later", "lesser;later", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3-or-later", "lesser;later", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-or-later", "affero;later", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "gnu;warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "lesser;warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license"),
    ("gpl", "gnu;received", r"you should have received a copy of the gnu general public license along with this (?:program|software|file|package)"),
    ("lgpl", "lesser;received", r"you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file|package)"),
    ("agpl", "affero;received", r"you should have received a copy of the gnu affero general public license along with this (?:program|software|file)"),
    ("gfdl", "documentation;copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla;source", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla;contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "eclipse;accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse;accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("cddl-1", "development;contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "express;implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "origin;misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("boost-1", "executables;derivative", r"all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("artistic-1", "copyright;artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("postgresql", "permission;agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl;toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("python-2", "psf", r"psf is making python available to licensee on an as is basis"),
    ("perl", "perl", r"(?:you can redistribute it and or modify it|free software you may redistribute it) under the same terms as perl(?: 5 programming language system)? itself"),
    ("cc0", "waive waived", r"to the extent possible under law (?:\w+ ){1,10}has waived all copyright and related or neighboring rights"),
    ("cc-by", "creative", r"this (?:work|article|document|text|page|content) is licensed under a creative commons attribution(?: \d 0)?(?: international)? licen[sc]e"),
    ("cc-by-sa", "creative", r"this (?:work|article|document|text|page|content) is licensed under a creative commons attribution share ?alike(?: \d 0)?(?: international)? licen[sc]e"),
    ("cc-by-nc", "creative", r"this (?:work|article|document|text|page|content) is licensed under a creative commons attribution non ?commercial(?: \d 0)?(?: international)? licen[sc]e"),
    ("openrail-m", "restrictions;use", r"use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("public-domain", "domain", r"(?:dedicated|released|placed|published|donated)(?: in| into| to)(?: the)? public domain"),
    ("public-domain", "domain", r"this (?:work|file|image|text|document|software) is in the public domain"),
    ("public-domain", "gemeinfrei domaine dominio", r"(?:gemeinfrei|dans le domaine public|de dominio público)"),
    ("proprietary", "reserved", r"(?:copyright (?:\w+ ){1,8})?all rights reserved"),
    ("proprietary", "vorbehalten réservés reservados", r"(?:alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)"),
    ("proprietary", "proprietary;confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized unauthorised", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|work|document|software|material)(?: via any medium)? is (?:strictly )?prohibited"),
    ("proprietary", "reproduced;permission", r"no part of this (?:publication|book|document|work) may be reproduced(?: \w+){0,30} without (?:the )?(?:prior )?(?:written )?permission"),
    ("no-commercial-use", "commercial", r"(?:for non ?commercial use only|not for commercial use|commercial use (?:is )?(?:prohibited|not (?:permitted|allowed)))"),
    ("research-only", "research", r"(?:for research (?:purposes|use) only|for academic use only|for research and educational purposes only)"),
)

#: label, keywords, the words of an address or identifier.
ADDRESSES = (
    ("mit", "opensource", r"opensource org licenses? mit(?: license(?: php)?)?"),
    ("apache-2", "apache", r"apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", "opensource", r"opensource org licenses? apache 2 0"),
    ("bsd-2", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource", r"opensource org licenses? bsd license(?: php)?"),
    ("isc", "opensource", r"opensource org licenses? isc(?: license(?: txt)?)?"),
    ("gpl-2", "opensource gnu", r"(?:opensource org licenses? gpl 2 0|gnu org licenses old licenses gpl 2 0)"),
    ("gpl-3", "opensource gnu", r"(?:opensource org licenses? gpl 3 0|gnu org licenses gpl 3 0)"),
    ("lgpl-2.1", "opensource gnu", r"(?:opensource org licenses? lgpl 2 1|gnu org licenses old licenses lgpl 2 1)"),
    ("lgpl-3", "opensource gnu", r"(?:opensource org licenses? lgpl 3 0|gnu org licenses lgpl 3 0)"),
    ("agpl-3", "opensource gnu", r"(?:opensource org licenses? agpl 3 0|gnu org licenses agpl 3 0)"),
    ("gpl", "gnu", r"gnu org (?:licenses gpl|copyleft gpl)(?: html| txt)?"),
    ("lgpl", "gnu", r"gnu org (?:licenses lgpl|copyleft lesser)(?: html| txt)?"),
    ("gfdl", "gnu", r"gnu org (?:licenses|copyleft) fdl(?: html| 1 [23])?"),
    ("mpl-2", "mozilla", r"mozilla org (?:en us )?mpl 2 0|mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("epl-1", "eclipse", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2", "eclipse", r"eclipse org legal epl 2 0"),
    ("boost-1", "boost", r"boost org license 1 0(?: txt)?"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
    ("ofl-1.1", "sil", r"scripts sil org ofl"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd \d \d"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d \d"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d"),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?"),
    ("ogl-uk-3", "nationalarchives", r"nationalarchives gov uk doc open government licence version 3"),
    ("eupl-1.2", "joinup", r"joinup ec europa eu (?:\w+ ){0,6}eupl"),
    ("artistic-2", "opensource perlfoundation", r"(?:opensource org licenses? artistic license 2 0|perlfoundation org artistic license 2 0)"),
    ("zlib", "opensource zlib", r"(?:opensource org licenses? zlib(?: license(?: php)?)?|zlib net zlib license html)"),
    ("cecill-2", "cecill", r"cecill info licences licence cecill v2(?: 1)? (?:en|fr)"),
)


@dataclass(frozen=True)
class Rule:
    """``order`` is its place in the list; ``groups`` its keywords: one of each must be there."""

    order: int
    name: str
    label: str
    priority: int
    confidence: float
    base: bool
    groups: tuple[frozenset[bytes], ...]
    expression: "re.Pattern[bytes]"


def _words(text: str) -> frozenset[bytes]:
    return frozenset(w.encode() for w in text.split())


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, sentences, addresses, then notices, tags and titles by name."""
    out: list[Rule] = []

    def put(name: str, label: str, priority: int, pattern: str, *groups: str, base: bool = False) -> None:
        whole = re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())
        out.append(Rule(len(out), f"{name}:{label}:{len(out)}", label, priority, CONFIDENCE[priority], base, tuple(_words(g) for g in groups), whole))

    for phrase, label in BASE:
        put("base", label, NOTICE, phrase, *phrase.split(), base=True)
    for label, groups, pattern in SENTENCES:
        lead = rf"(?:{_UNDER} )?" if pattern.startswith("gnu ") else ""  # so that it contains the notice it ends
        put("sentence", label, SENTENCE, lead + pattern, *groups.split(";"))
    for label, keys, pattern in ADDRESSES:
        put("address", label, ADDRESS, pattern, keys, "org net com info uk eu")
    suffix = r"(?: (?:software |public |international |unported )*licen[sc]es?)?"
    for label, keys, name in NAMES:
        put("notice", label, NOTICE, rf"{_UNDER} {name}{suffix}", keys, _NOTICE_WORDS)
    for label, keys, name in NAMES:
        for words, lead in _FOREIGN:
            put("translated", label, NOTICE, rf"{lead} {name}(?: (?:licence|lizenz|licencia|license))?", keys, words, _LICENSE if label in ("mit", "isc", "ruby", "w3c") else words)
    for label, keys, name in NAMES:
        put("tag", label, TAG, rf"(?:spdx license identifier|licen[sc]es?(?: is| type| name| id)?|lizenz|licencia|licencia de) (?:the )?{name}", keys, _LICENSE)
    for label, keys, name in NAMES:
        put("title", label, TITLE, rf"(?:the )?{name}(?: software| style| public| dual)? licen[sc]es?", keys, _LICENSE)
    return tuple(out)
