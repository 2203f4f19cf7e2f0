"""License scan by ordered signature rules, in SQL functions.

Texts are words joined by blanks. A rule has a label, keywords, a priority and a regex; the table is
built from the names below, led by a grant or alone, from notices, and from short names after a marker. Each match of a
rule holds one of its keywords. A text without any is done after one set intersection; in others only rules
of which a keyword occurs are run, as literals in the plan. A detection is suppressed if another one contains it and has a higher priority, or the
same priority and a longer interval or an earlier rule; this takes a running maximum over sorted detections.

Base phrases are counted by their words, whatever the rules find, and their labels stay.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows get equal
results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, running, words

#: Phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

V = r"( version)?( v?[1-4])?( [0-9]{1,2})?( [0-9])?"  # a version after a name
#: Label, keywords of which each match holds one, and how the words of the name read.
FAMILIES = (
    ("aal", "assurance", r"attribution assurance license"),
    ("afl-3.0", "academic", rf"academic free license{V}"),
    ("agpl-3.0", "affero|agpl", rf"((gnu )?affero general public license|agpl){V}( or (any )?later( version)?)?"),
    ("aladdin", "aladdin", rf"aladdin free public license{V}"),
    ("amdplpa", "amdplpa|amd", r"amdplpa|amd s plpa map license"),
    ("aml", "apple", r"apple mit license"),
    ("apache-1.0", "apache", r"apache( software)? license( version)? 1 0"),
    ("apache-1.1", "apache", r"apache( software)? license( version)? 1 1"),
    ("apache-2.0", "apache", r"apache( software)? license( version)?( v?2)?( 0)?"),
    ("apl-1.0", "adaptive", rf"adaptive public license{V}"),
    ("apsl-2.0", "apple", rf"apple public source license{V}"),
    ("artistic-1.0", "artistic", r"artistic license( version)? 1( 0)?"),
    ("artistic-2.0", "artistic", r"artistic license( version)?( 2)?( 0)?"),
    ("barr", "barr", r"barr license"),
    ("beerware", "beerware|beer", r"beerware license|beer ware license"),
    ("bittorrent-1.1", "bittorrent", rf"bittorrent open source license{V}"),
    ("blueoak-1.0.0", "oak", rf"blue oak model license{V}"),
    ("borceux", "borceux", r"borceux license"),
    ("bsd-0-clause", "0bsd|bsd", r"0bsd|(zero clause bsd|bsd 0 clause|bsd zero clause)( license)?"),
    ("bsd-1-clause", "bsd", r"(bsd 1 clause|1 clause bsd)( license)?"),
    ("bsd-2-clause", "bsd|freebsd", r"(simplified bsd|freebsd|bsd 2 clause|2 clause bsd)( license)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause (plus patent|patent)( license)?"),
    ("bsd-3-clause", "bsd", r"(new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)( license)?"),
    ("bsd-3-clause-clear", "bsd", r"(bsd 3 clause clear|clear bsd)( license)?"),
    ("bsd-3-clause-lbnl", "lawrence|lbnl", r"lawrence berkeley national labs bsd variant license|bsd 3 clause lbnl"),
    ("bsd-4-clause", "bsd", r"(original bsd|bsd 4 clause|4 clause bsd)( license)?"),
    ("bsd-source-code", "bsd", r"bsd source code attribution"),
    ("bsd", "bsd", r"bsd( style)? license"),
    ("bsl-1.0", "boost", rf"boost software license{V}"),
    ("busl-1.1", "business", rf"business source license{V}"),
    ("bzip2-1.0.6", "bzip2", rf"bzip2( and libbzip2)? license{V}"),
    ("caldera", "caldera", r"caldera license"),
    ("catosl-1.1", "trusted", rf"computer associates trusted open source license{V}"),
    ("cc0-1.0", "cc0|zero", r"(creative commons )?cc0( 1)?( 0)?( universal)?|creative commons zero( v?1)?( 0)?( universal)?"),
    ("cc-by", "cc", r"cc by( [1-4])?( [05])?"),
    ("cc-by-nc", "cc", r"cc by nc( [1-4])?( [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd( [1-4])?( [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa( [1-4])?( [05])?"),
    ("cc-by-nd", "cc", r"cc by nd( [1-4])?( [05])?"),
    ("cc-by-sa", "cc", r"cc by sa( [1-4])?( [05])?"),
    ("cc-attribution", "attribution", r"creative commons attribution( [1-4])?( [05])?( international| unported| generic)?( license)?"),
    ("cc-attribution-nc", "attribution", r"creative commons attribution non ?commercial( [1-4])?( [05])?( international| unported)?( license)?"),
    ("cc-attribution-nc-sa", "attribution", r"creative commons attribution non ?commercial share ?alike( [1-4])?( [05])?( international| unported)?( license)?"),
    ("cc-attribution-nc-nd", "attribution", r"creative commons attribution non ?commercial no ?deriv(ative)?s( [1-4])?( [05])?( international| unported)?( license)?"),
    ("cc-attribution-sa", "attribution", r"creative commons attribution share ?alike( [1-4])?( [05])?( international| unported)?( license)?"),
    ("cc-attribution-nd", "attribution", r"creative commons attribution no ?deriv(ative)?s( [1-4])?( [05])?( international| unported)?( license)?"),
    ("cddl-1.0", "cddl|distribution", rf"common development and distribution license( cddl)?{V}|cddl{V}"),
    ("cdla-permissive", "cdla|data", rf"community data license agreement permissive{V}|cdla permissive{V}"),
    ("cdla-sharing", "cdla|data", rf"community data license agreement sharing{V}|cdla sharing{V}"),
    ("cecill-2.1", "cecill", r"cecill( free software)?( license)?( agreement)?( 2)?( 1)?"),
    ("cecill-b", "cecill", r"cecill b( free software)?( license)?( agreement)?"),
    ("cecill-c", "cecill", r"cecill c( free software)?( license)?( agreement)?"),
    ("cern-ohl", "cern", rf"cern open hardware licen[cs]e{V}( (strongly|weakly) reciprocal| permissive)?"),
    ("clartistic", "clarified", r"clarified artistic license"),
    ("cnri-python", "cnri", r"cnri (open source gpl compatible )?(python )?license( agreement)?"),
    ("condor-1.1", "condor", rf"condor public license{V}"),
    ("cpal-1.0", "cpal|attribution", rf"common public attribution license{V}|cpal{V}"),
    ("cpl-1.0", "common", rf"common public license{V}"),
    ("cpol-1.02", "cpol|project", rf"code project open license{V}|cpol{V}"),
    ("cua-opl-1.0", "cua", rf"cua office public license{V}"),
    ("curl", "curl", r"curl license"),
    ("ecl-2.0", "educational", rf"educational community license{V}"),
    ("ecos-2.0", "ecos", rf"ecos license{V}"),
    ("efl-2.0", "eiffel", rf"eiffel forum license{V}"),
    ("elastic-2.0", "elastic", rf"elastic license{V}"),
    ("entessa", "entessa", rf"entessa public license{V}"),
    ("epl-1.0", "eclipse", r"eclipse public license( version)? v?1( 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license( version)?( v?2)?( 0)?"),
    ("edl-1.0", "eclipse", rf"eclipse distribution license{V}"),
    ("erlpl-1.1", "erlang", rf"erlang public license{V}"),
    ("etalab-2.0", "etalab", rf"etalab( open)? licen[cs]e{V}"),
    ("eudatagrid", "datagrid", r"eu datagrid software license"),
    ("eupl-1.2", "eupl|european", rf"european union public licen[cs]e{V}|eupl{V}"),
    ("fair", "fair", r"fair license"),
    ("frameworx-1.0", "frameworx", rf"frameworx( open)? license{V}"),
    ("fsl-1.1", "functional", rf"functional source license{V}"),
    ("ftl", "freetype", r"freetype( project)? license"),
    ("gfdl-1.3", "documentation", r"(gnu )?free documentation license( version)?( 1)?( [123])?( or (any )?later( version)?)?"),
    ("gpl-1.0", "general", r"(gnu )?general public license( version)? v?1( 0)?"),
    ("gpl-2.0", "general|gplv2", r"(gnu )?general public license( version)? v?2( 0)?|gplv2"),
    ("gpl-2.0-or-later", "later", r"(gnu )?general public license( version)? v?2( 0)? or (at your option )?(any )?later( version)?"),
    ("gpl-3.0", "general|gplv3", r"(gnu )?general public license( version)? v?3( 0)?|gplv3"),
    ("gpl-3.0-or-later", "later", r"(gnu )?general public license( version)? v?3( 0)? or (at your option )?(any )?later( version)?"),
    ("gpl-classpath", "classpath", r"(gpl|general public license)( version)?( v?2)?( 0)? with( the)? classpath exception"),
    ("gpl", "general", r"(gnu )?general public license"),
    ("gust-font", "gust", r"gust font license"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("ibm-pibs", "ibm", r"ibm powerpc initialization and boot software"),
    ("icu", "icu", r"icu license"),
    ("ijg", "jpeg|ijg", r"independent jpeg group license|ijg license"),
    ("imagemagick", "imagemagick", r"imagemagick license"),
    ("intel", "intel", r"intel open source license"),
    ("ipa", "ipa", r"ipa font license"),
    ("ipl-1.0", "ibm", rf"ibm public license{V}"),
    ("isc", "isc", r"isc license"),
    ("jasper-2.0", "jasper", rf"jasper license{V}"),
    ("jpnic", "jpnic|japan", r"japan network information center license|jpnic license"),
    ("json", "json", r"json license"),
    ("lal-1.3", "art|libre", rf"(free art|licence art libre) license{V}|licence art libre{V}"),
    ("lgpl", "lesser|library|lgpl", r"((gnu )?(lesser|library) general public license|lgpl)( version)?( v?[23])?( [01])?( or (any )?later( version)?)?"),
    ("libpng", "libpng", r"libpng license( version 2)?"),
    ("libtiff", "libtiff", r"libtiff license"),
    ("lppl-1.3c", "latex|lppl", r"(latex project public license|lppl)( version)?( 1)?( 3c?)?"),
    ("lucent-1.02", "lucent", rf"lucent public license{V}"),
    ("liliq", "quebec|liliq", rf"licence libre du quebec{V}|liliq{V}"),
    ("miros", "miros", r"miros licen[cs]e"),
    ("mit", "mit|expat", r"mit license|expat license"),
    ("mit-0", "mit", r"mit no attribution( license)?|mit 0"),
    ("motosoto", "motosoto", r"motosoto license"),
    ("mpich2", "mpich2", r"mpich2 license"),
    ("mpl-1.0", "mozilla", r"mozilla public license( version)? 1 0"),
    ("mpl-1.1", "mozilla|mpl", r"mozilla public license( version)? 1 1|mpl 1 1"),
    ("mpl-2.0", "mozilla|mpl", r"mozilla public license( version)?( v?2)?( 0)?|mpl 2 0"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("mulan-2.0", "mulan", rf"mulan (permissive software|psl) license{V}"),
    ("multics", "multics", r"multics license"),
    ("nasa-1.3", "nasa", rf"nasa open source agreement{V}"),
    ("naumen", "naumen", r"naumen public license"),
    ("ncsa", "ncsa", r"(university of illinois )?ncsa( open source)? license"),
    ("netcdf", "netcdf", r"netcdf license"),
    ("nethack", "nethack", r"nethack general public license"),
    ("ngpl", "nethack|ngpl", r"ngpl"),
    ("nokia", "nokia", r"nokia open source license"),
    ("npl-1.1", "netscape", rf"netscape public license{V}"),
    ("nposl-3.0", "profit", rf"non profit open software license{V}"),
    ("ntp", "ntp", r"ntp license"),
    ("oclc-2.0", "oclc", rf"oclc research public license{V}"),
    ("odbl-1.0", "database|odbl", r"open (data commons )?database license( v?1)?( 0)?|odbl"),
    ("odc-by-1.0", "odc", rf"odc attribution license{V}|odc by{V}"),
    ("ofl-1.1", "font", r"(sil )?open font license( version)?( 1)?( 1)?"),
    ("ogl-uk-3.0", "government", rf"open government licen[cs]e{V}"),
    ("ogtsl", "test", r"open group test suite license"),
    ("oldap-2.8", "openldap", rf"openldap public license{V}"),
    ("openrail", "openrail|rail", r"(creativeml |bigscience |bigcode )?open ?rail( m)?( license)?"),
    ("openssl", "openssl", r"openssl license"),
    ("opl-1.0", "content", rf"open content license{V}"),
    ("opubl-1.0", "publication", rf"open publication license{V}"),
    ("oset-pl-2.1", "oset", rf"oset (foundation )?public license{V}"),
    ("osl-3.0", "software", r"open software license( version)?( v?3)?( 0)?"),
    ("parity-7.0", "parity", rf"parity public license{V}"),
    ("pddl-1.0", "dedication", r"public domain dedication( and license)?( v?1)?( 0)?"),
    ("php-3.01", "php", r"php license( version)?( 3)?( 01)?"),
    ("polyform-nc-1.0", "polyform", rf"polyform noncommercial license{V}"),
    ("polyform-small-1.0", "polyform", rf"polyform small business license{V}"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("psf-2.0", "psf|python", rf"python software foundation license{V}|psf license{V}"),
    ("python-2.0", "python", r"python license( version)?( 2)?"),
    ("qpl-1.0", "qpl|q", rf"q public license{V}|qpl{V}"),
    ("rpl-1.5", "reciprocal", rf"reciprocal public license{V}"),
    ("rpsl-1.0", "realnetworks", rf"realnetworks public source license{V}"),
    ("ruby", "ruby", r"ruby license"),
    ("rscpl", "ricoh", rf"ricoh source code public license{V}"),
    ("sgi-b-2.0", "sgi", rf"sgi free software license( b)?{V}"),
    ("simpl-2.0", "simple", rf"simple public license{V}"),
    ("sissl-1.1", "sun", rf"sun industry standards source license{V}"),
    ("sleepycat", "sleepycat", r"sleepycat( public)? license"),
    ("spl-1.0", "sun", rf"sun public license{V}"),
    ("sspl-1.0", "server", rf"server side public license{V}"),
    ("tcl", "tcl", r"tcl( tk)? license"),
    ("ucl-1.0", "upstream", rf"upstream compatibility license{V}"),
    ("unicode-dfs", "unicode", r"unicode( inc)? license( agreement)?( data files and software)?"),
    ("unlicense", "unlicense", r"(the )?unlicense"),
    ("upl-1.0", "universal", rf"universal permissive license{V}"),
    ("vim", "vim", r"vim license"),
    ("vsl-1.0", "vovida", rf"vovida software license{V}"),
    ("w3c", "w3c", r"w3c( software)?( notice and)? license"),
    ("watcom-1.0", "watcom", rf"sybase open watcom public license{V}"),
    ("wtfpl", "wtfpl", r"wtfpl( version)?( 2)?"),
    ("x11", "x11", r"x11 license"),
    ("xfree86-1.1", "xfree86", rf"xfree86 license{V}"),
    ("zend-2.0", "zend", rf"zend license{V}"),
    ("zlib", "zlib", r"zlib( libpng)? license"),
    ("zpl-2.1", "zope", rf"zope public license{V}"),
)
LED = r"((dual )?(licensed|licenced|released|distributed|available|published|provided|offered|shared) (freely )?(under|with) |subject to |governed by |covered by |in accordance with |under )(the )?(terms (and conditions )?of )?(the )?"
#: Priority and the words before a name: led by a grant, or alone.
FORMS = ((85, LED), (50, r""))
#: Notices that name no licence: label, keywords, priority, words.
NOTICES = (
    ("mit", "granted", 70, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", 66, r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", 66, r"shall be included in all copies or substantial portions of the software"),
    ("isc", "fee", 70, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("hpnd", "fee", 68, r"permission to use copy modify and distribute this software and its documentation for any purpose( and)? without fee"),
    ("bsd", "redistribution", 70, r"redistribution and use in source and binary forms( with or without modification)?( are permitted)?"),
    ("bsd", "redistributions", 66, r"redistributions (of source code|in binary form) must (retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", "endorse", 68, r"(may|to) (not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 68, r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", 70, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "perpetual", 64, r"perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|patent) license"),
    ("gpl", "redistribute", 70, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "verbatim", 60, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("agpl-3.0", "remotely", 66, r"all users interacting with it remotely through a computer network"),
    ("mpl-2.0", "mozilla", 70, r"this source code form is subject to the terms of the mozilla public license"),
    ("epl-2.0", "accompanying", 66, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "altered", 65, r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", 65, r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", 68, r"free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 68, r"do what the fuck you want to public license"),
    ("beerware", "beer", 66, r"you can buy me a beer in return"),
    ("cc0-1.0", "waived", 66, r"has waived all copyright and related( or neighboring)? rights"),
    ("boost", "machine", 60, r"solely in the form of machine executable object code generated by a source language processor"),
    ("perl", "perl", 62, r"(under )?the same terms as perl( 5)?( itself)?"),
    ("public-domain", "domain", 60, r"(released|dedicated|placed|committed) (in|in to|into|to) the public domain"),
    ("public-domain", "domain", 40, r"public domain"),
    ("public-domain", "disclaims", 58, r"the author disclaims copyright to this source code"),
    ("no-commercial-use", "commercial", 60, r"(for )?non commercial use only|no commercial use( allowed| permitted)?|not for commercial use"),
    ("no-commercial-use", "noncommercial", 60, r"noncommercial (use|purposes) only"),
    ("personal-use", "personal", 55, r"for (your )?personal( and private)? use only"),
    ("research-use", "research", 55, r"for (academic|scientific) research( purposes| use)? only|for research( purposes| use) only"),
    ("evaluation-use", "evaluation", 55, r"for evaluation( purposes| use)? only"),
    ("no-redistribution", "reproduce|redistribute|copy", 60, r"(may not|must not|do not) (copy|reproduce|redistribute) without( prior)?( written)? permission"),
    ("no-redistribution", "reproduced", 60, r"no part of this (publication|book|document|work) may be reproduced"),
    ("no-redistribution", "republished|retransmitted|redistributed", 58, r"may not be (republished|retransmitted|redistributed)"),
    ("no-derivatives", "derivative", 50, r"(no|without) derivative works( are)?( permitted| allowed)?"),
    ("no-training", "training", 60, r"may not be used (for|in) (the )?training( of)?( machine learning| ai)?( models)?"),
    ("no-mining", "mining", 58, r"text and data mining (is )?(not permitted|prohibited|reserved)"),
    ("proprietary", "proprietary", 50, r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized", 50, r"unauthorized (copying|reproduction|distribution|use) (of this (file|work|material) )?is (strictly )?prohibited"),
    ("proprietary", "secrets", 46, r"contains( proprietary)? trade secrets"),
    ("permission", "courtesy", 35, r"by courtesy of|courtesy of"),
    ("permission", "reprinted|reproduced", 40, r"(reprinted|reproduced) (with|by)( kind)? permission( of| from)?"),
    ("attribution", "credited", 40, r"(must|should) be credited( as)?"),
    ("trademark", "trademark|trademarks", 30, r"(are|is)( a)?( registered)? (trademarks?)( or registered trademarks)? of"),
    ("patent", "patent|patents", 30, r"(covered by|protected by)( one or more)?( us)? patents?"),
    ("terms-of-use", "terms", 30, r"subject to (the |our )?terms of (use|service)"),
    ("warranty-disclaimer", "provided|distributed", 55, r"(provided|distributed) (on an )?as is( basis)?( without warranty of any kind)?"),
    ("warranty-disclaimer", "merchantability", 54, r"warrant(y|ies) of merchantability( and| or)?( fitness)?"),
    ("warranty-disclaimer", "warranty", 52, r"without any warranty( without even the implied warranty)?"),
    ("liability-disclaimer", "liable", 52, r"in no event (shall|will) the (authors?|copyright holders?|contributors?)( or (copyright holders|contributors))? be liable"),
    ("liability-disclaimer", "consequential", 50, r"(direct )?indirect incidental special exemplary or consequential damages"),
    ("reserved", "reserved", 45, r"all rights reserved"),
    ("reserved", "vorbehalten", 45, r"alle rechte vorbehalten"),
    ("reserved", "droits", 45, r"tous droits r[^ ]+serv[^ ]+s"),
    ("reserved", "derechos", 45, r"todos los derechos reservados"),
    ("reserved", "diritti", 45, r"tutti i diritti riservati"),
    ("reserved", "direitos", 45, r"todos os direitos reservados"),
    ("reserved", "rechten", 45, r"alle rechten voorbehouden"),
    ("some-reserved", "reserved", 46, r"(some|certain) rights reserved"),
    ("no-reserved", "reserved", 46, r"no rights reserved"),
    ("copyleft", "copyleft", 35, r"copyleft( c)?"),
    ("copyright", "copyright", 30, r"copyright( c)?( by)? (19|20)[0-9]{2}( (19|20)[0-9]{2})?( by)?"),
    ("copyright", "copyright", 20, r"copyright"),
    ("copyright", "copyrighted", 20, r"copyrighted( material| work| by)?"),
)
#: Short names that stand after an SPDX marker.
SPDX = ("0bsd", "aal", "afl 3 0", "agpl 3 0 only", "agpl 3 0 or later", "apache 2 0", "artistic 2 0", "bsd 2 clause", "bsd 3 clause", "bsl 1 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "cddl 1 0", "epl 2 0", "eupl 1 2", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "isc", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "mit", "mpl 2 0", "ncsa", "ofl 1 1", "openssl", "postgresql", "unlicense", "w3c", "wtfpl", "zlib")
MARK = r"spdx license identifier "


def rules() -> list[tuple[int, str, str, int, str]]:
    """(order, label, keywords, priority, regex) of all rules, several hundred."""
    out = []
    for label, key, name in FAMILIES:
        for priority, before in FORMS:
            out.append((label, key, priority + (1 if "later" in key else 0), f"{before}(?:{name})"))
    out += [(label, key, priority, f"(?:{text})") for label, key, priority, text in NOTICES]
    out += [(x.replace(" ", "-"), "spdx", 100, f"{MARK}{x}") for x in SPDX]
    return [(k, label, key, priority, f"(?<= ){regex}(?= )") for k, (label, key, priority, regex) in enumerate(out)]


_FOUND = "array<struct<start:int,end:int,priority:int,ord:int,label:string>>"


def _spans(hit: Column) -> Column:
    """(start, end, priority, ord, label) of the places that a rule has marked: pieces lie outside and inside by turns."""

    def place(widths: Column) -> Column:
        both = F.arrays_zip(F.slice(running(widths), F.lit(1), F.size(widths)).alias("at"), widths.alias("n"))
        return F.filter(both, lambda x, i: i % 2 == 1)

    inside = let(F.transform(F.split(hit["marked"], "[\x01\x02]", -1), F.char_length), place)
    return F.transform(inside, lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["n"]).alias("end"), hit["priority"].alias("priority"), hit["ord"].alias("ord"), hit["label"].alias("label")))


def survivors(hits: Column, priorities: list[int]) -> Column:
    """The ``hits`` (start, end, priority, ord, label) that no other one suppresses: one that contains it and has a higher
    priority, or the same and is longer or an earlier rule. In order of start, then priority and end from the largest on, a hit is
    suppressed if one before it, of its priority at least, reaches its end: one running maximum a priority, and no pairs.
    """
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["priority"]).alias("p"), (-h["end"]).alias("e"), h["ord"].alias("ord"), h["label"].alias("label"))))
    levels = sorted(set(priorities))

    def ends(p: int):
        return lambda h: F.when(-h["p"] >= p, -h["e"]).otherwise(F.lit(0))

    def alone(o: Column) -> Column:
        reach = F.arrays_zip(o.alias("h"), *[F.slice(running(F.transform(o, ends(p)), "max"), F.lit(1), F.size(o)).alias(f"r{p}") for p in levels])
        own = lambda x: F.coalesce(*[F.when(-x["h"]["p"] == p, x[f"r{p}"]) for p in levels])
        kept = F.filter(reach, lambda x: own(x) < -x["h"]["e"])
        return F.transform(kept, lambda x: F.struct(x["h"]["start"].alias("start"), (-x["h"]["e"]).alias("end"), (-x["h"]["p"]).alias("priority"), x["h"]["ord"].alias("ord"), x["h"]["label"].alias("label")))

    return let(order, alone)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), table: list[tuple[int, str, str, int, str]] | None = None) -> DataFrame:
    """``keep`` columns, n_words, base (array of (at, label)), detections (surviving rule matches)."""
    table = table or rules()
    keys = sorted({k for r in table for k in r[2].split("|")})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), words(F.col("text")).alias("w"))
    starts = []
    for phrase, label in BASE:
        p = phrase.split()
        test = " and ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(p))
        starts.append(f"if(array_contains(w, '{p[0]}') and array_contains(w, '{p[-1]}'), transform(filter(sequence(0, size(w) - 1), i -> {test}), i -> named_struct('at', i, 'label', '{label}')), array())")
    rows = rows.withColumn("base", F.expr(f"concat({', '.join(starts)})"))
    known = F.array(*[F.lit(k) for k in keys])
    rows = rows.select("_kept", F.size("w").cast("long").alias("n_words"), "base", F.array_intersect("w", known).alias("keys"), F.when(F.arrays_overlap("w", known), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).alias("norm"))
    # literal rules, each compiled once; one pass marks its matches by characters that no word holds
    here = lambda k: " or ".join(f"array_contains(keys, '{x}')" for x in k.split("|"))
    marked = ", ".join(rf"if(({here(key)}) and rlike(norm, r'{regex}'), named_struct('ord', {o}, 'label', '{label}', 'priority', {pri}, 'marked', regexp_replace(norm, r'{regex}', '\u0001$0\u0002')), null)" for o, label, key, pri, regex in table)
    hits = F.flatten(F.transform(F.array_compact(F.expr(f"array({marked})")), _spans))
    rows = rows.select("_kept", "n_words", "base", F.when(F.size("keys") > 0, hits).alias("_hits"))
    kept = F.when(F.size("_hits") > 0, survivors(F.col("_hits"), [r[3] for r in table]))
    return rows.select("_kept.*", "n_words", "base", F.coalesce(kept, F.expr(f"cast(array() as {_FOUND})")).alias("detections"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    at = F.transform("base", lambda b: b["at"].cast("long"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_distinct(F.concat("base.label", "detections.label")))
    score = F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max("detections.priority") / 101, F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    """Every rule on every text, without keywords; suppression over pairs. Two blanks between words, so that a match may take those at its edges."""
    marks = []
    for o, label, _, priority, regex in rules():
        wide = regex.removeprefix("(?<= )").removesuffix("(?= )").replace("[^ ]", r"\S").replace(" ", "  ")
        marks.append(f"CASE WHEN regexp_matches(n, ' {wide} ') THEN {{'ord': {o}, 'label': '{label}', 'priority': {priority}, 'marked': regexp_replace(n, ' {wide} ', chr(1) || '\\0' || chr(2), 'g')}} END")
    places = []
    for phrase, label in BASE:
        p = phrase.split()
        places.append(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, i, w, {', '.join(f'lead(w, {k}) OVER x AS w{k}' for k in range(1, len(p)))} FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)) WHERE w = '{p[0]}' AND {' AND '.join(f"w{k} = '{y}'" for k, y in enumerate(p) if k)}")
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
place AS ({" UNION ALL ".join(places)}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY doc_id),
mark AS (SELECT doc_id, unnest(list_filter([{", ".join(marks)}], lambda m: m IS NOT NULL)) AS m FROM (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS n FROM w)),
piece AS (SELECT doc_id, m.ord AS ord, m.label AS label, m.priority AS priority, unnest(string_split_regex(m.marked, '[\x01\x02]')) AS t, unnest(range(2 + length(m.marked))) AS k FROM mark),
ends AS (SELECT doc_id, ord, label, priority, k, sum(length(t)) OVER (PARTITION BY doc_id, ord ORDER BY k) AS z, length(t) AS n FROM piece WHERE t IS NOT NULL),
hit AS MATERIALIZED (SELECT doc_id, ord, label, priority, z - n AS a, z FROM ends WHERE k % 2 = 1),
kept AS (
  SELECT * FROM hit x WHERE NOT EXISTS (
    FROM hit y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND y.z >= x.z AND (y.priority > x.priority OR y.priority = x.priority AND (y.z - y.a > x.z - x.a OR y.z - y.a = x.z - x.a AND y.ord < x.ord)))),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(priority) AS top FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0 END, coalesce(top / 101, 0)) AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN found ON w.doc_id = found.doc_id
"""


#: Null places: compared by typed values.
NULLABLE_SQL = _sql()
