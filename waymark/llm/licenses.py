"""License scans: ordered signature rules, called up by phrases derived from them, in DataFrame operations only.

A text is read as its words (digits, a-z and non-ASCII characters; A-Z lower-cased), joined by single
spaces, so a rule needs no thought for punctuation or line ends. One regex finds the anchors, words of
which every rule's matches hold one; an anchor leads to phrases, and a phrase that the text holds calls
up its rules; each reports the intervals it matches. A detection is dropped if another of the same or a
higher tier contains it; between equal intervals the higher tier, then the earlier rule wins. Base
phrases are found word by word, and their labels always stay.

Defined results: a null, empty or wordless text has no words, labels "" and score 0; repeated rows are
judged one by one; a very long text is scanned whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: The base phrases and labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Tiers: a declared identifier or address, a name with its version, a bare name or notice.
DECLARED, VERSIONED, NAMED = 3, 2, 1
SCORES = {DECLARED: 1.0, VERSIONED: 0.9, NAMED: 0.7}
BASE_SCORE = 0.6
#: What stands between words, once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: label, keyword (in every match of the name), name (regex over words), versions, address (regex over words, or None).
FAMILIES = [
    ("gpl", "gpl", "(gnu )?gpl", ["1 0", "2 0", "3 0"], "gnu org licenses( old licenses)? gpl"),
    ("gpl", "general public license", "(gnu )?general public license", ["1 0", "2 0", "3 0"], "gnu org copyleft gpl"),
    ("lgpl", "lgpl", "(gnu )?lgpl", ["2 0", "2 1", "3 0"], "gnu org licenses( old licenses)? lgpl"),
    ("lgpl", "general public license", "(gnu )?(lesser|library) general public license", ["2 0", "2 1", "3 0"], "gnu org copyleft lesser"),
    ("agpl", "agpl", "(gnu )?agpl", ["1 0", "3 0"], "gnu org licenses agpl"),
    ("agpl", "affero", "(gnu )?affero general public license", ["1 0", "3 0"], "affero org oagpl"),
    ("gfdl", "documentation license", "(gnu )?free documentation license", ["1 1", "1 2", "1 3"], "gnu org (licenses|copyleft) fdl"),
    ("apache", "apache", "apache( software)? license", ["1 0", "1 1", "2 0"], "apache org licenses license"),
    ("mit", "mit", "(the )?mit license", [], "opensource org licenses mit"),
    ("mit", "expat", "expat license", [], "jclark com xml copying"),
    ("mit-0", "mit no attribution", "mit no attribution( license)?", [], "opensource org licenses mit 0"),
    ("bsd", "bsd", "((2|3|4|two|three|four) clause )?bsd( style)? license", [], "opensource org licenses bsd license"),
    ("bsd-2-clause", "bsd", "(simplified|freebsd|2 clause|two clause) bsd license", [], "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(new|modified|revised|3 clause|three clause) bsd license", [], "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(original|old|4 clause|four clause) bsd license", [], "spdx org licenses bsd 4 clause"),
    ("0bsd", "0bsd", "0bsd( license)?", [], "opensource org licenses 0bsd"),
    ("0bsd", "zero clause bsd", "zero clause bsd( license)?", [], None),
    ("isc", "isc", "isc license", [], "opensource org licenses isc"),
    ("mpl", "mozilla", "mozilla public license", ["1 0", "1 1", "2 0"], "mozilla org mpl"),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2 0"], "mozilla org en us mpl"),
    ("epl", "eclipse", "eclipse public license", ["1 0", "2 0"], "eclipse org legal epl"),
    ("epl", "epl", "epl", ["1 0", "2 0"], "opensource org licenses epl"),
    ("edl", "eclipse", "eclipse distribution license", ["1 0"], "eclipse org org documents edl"),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"], "opensource org licenses cddl"),
    ("cddl", "development and distribution", "common development and distribution license", ["1 0", "1 1"], "oracle com cddl"),
    ("cpl", "common public", "common public license", ["1 0"], "opensource org licenses cpl"),
    ("eupl", "european union public", "european union public licen[sc]e", ["1 0", "1 1", "1 2"], "joinup ec europa eu"),
    ("eupl", "eupl", "eupl", ["1 0", "1 1", "1 2"], "eupl eu"),
    ("artistic", "artistic", "artistic license", ["1 0", "2 0"], "opensource org licenses artistic license"),
    ("bsl", "boost software", "boost software license", ["1 0"], "boost org license"),
    ("busl", "business source", "business source license", ["1 0", "1 1"], "mariadb com bsl"),
    ("sspl", "server side public", "server side public license", ["1 0"], "mongodb com licensing server side"),
    ("elastic", "elastic", "elastic license", ["1 0", "2 0"], "elastic co licensing elastic license"),
    ("zlib", "zlib", "zlib( libpng)? license", [], "opensource org licenses zlib"),
    ("libpng", "libpng", "libpng license", ["1 0", "2 0"], "libpng org pub png src libpng license"),
    ("libpng", "png reference library", "png reference library license", ["1 0", "2 0"], None),
    ("openssl", "openssl", "openssl license", [], "openssl org source license"),
    ("curl", "curl", "curl license", [], "curl se docs copyright"),
    ("python", "python", "python( software foundation)? license", ["2 0"], "docs python org license"),
    ("python", "psf", "psf license", ["2 0"], None),
    ("php", "php", "php license", ["3 0", "3 01"], "php net license"),
    ("ruby", "ruby", "ruby license", [], "ruby lang org en about license"),
    ("perl", "perl", "same terms as perl( itself)?", [], "dev perl org licenses"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", [], "postgresql org about licence"),
    ("unicode", "unicode", "unicode license( agreement)?", ["3 0"], "unicode org license"),
    ("w3c", "w3c", "w3c software( notice and)? license", [], "w3 org consortium legal"),
    ("ofl", "open font", "(sil )?open font license", ["1 0", "1 1"], "scripts sil org ofl"),
    ("ofl", "ofl", "ofl", ["1 0", "1 1"], "openfontlicense org"),
    ("odbl", "open database", "open database license", ["1 0"], "opendatacommons org licenses odbl"),
    ("odc-by", "open data commons", "open data commons attribution license", ["1 0"], "opendatacommons org licenses by"),
    ("pddl", "public domain dedication", "(open data commons )?public domain dedication and license", ["1 0"], "opendatacommons org licenses pddl"),
    ("cc0", "cc0", "cc0( universal)?", ["1 0"], "creativecommons org publicdomain zero"),
    ("cc-by", "cc by", "cc by", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creativecommons org licenses by"),
    ("cc-by", "creative commons", "creative commons attribution( international)?( license)?", ["1 0", "2 0", "2 5", "3 0", "4 0"], None),
    ("cc-by-sa", "cc by sa", "cc by sa", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creativecommons org licenses by sa"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike( license)?", ["2 0", "2 5", "3 0", "4 0"], None),
    ("cc-by-nc", "cc by nc", "cc by nc", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creativecommons org licenses by nc"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial( license)?", ["2 0", "2 5", "3 0", "4 0"], None),
    ("cc-by-nd", "cc by nd", "cc by nd", ["2 0", "2 5", "3 0", "4 0"], "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", ["2 0", "2 5", "3 0", "4 0"], "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", ["2 0", "2 5", "3 0", "4 0"], "creativecommons org licenses by nc nd"),
    ("public-domain", "public domain", "(released|placed|dedicated) (in|into|to) the public domain", [], "creativecommons org publicdomain mark"),
    ("unlicense", "unlicense", "(the )?unlicense", [], "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl", ["2 0"], "wtfpl net"),
    ("beerware", "beerware", "beerware license", [], None),
    ("ms-pl", "microsoft", "microsoft public license", [], "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", [], "opensource org licenses ms rl"),
    ("apsl", "apple public source", "apple public source license", ["1 0", "2 0"], "opensource apple com apsl"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa( open source)? license", [], "opensource org licenses ncsa"),
    ("afl", "academic free", "academic free license", ["1 2", "2 1", "3 0"], "opensource org licenses afl"),
    ("osl", "open software", "open software license", ["1 0", "2 1", "3 0"], "opensource org licenses osl"),
    ("cecill", "cecill", "cecill( free software license( agreement)?)?", ["1 0", "2 0", "2 1"], "cecill info"),
    ("ogl", "open government", "open government licen[sc]e", ["1 0", "2 0", "3 0"], "nationalarchives gov uk doc open government licence"),
    ("vim", "vim", "vim license", [], "vimhelp org uganda"),
    ("x11", "x11", "x11 license", [], "x org docs license"),
]
#: Notices without a name: label, keyword, regex.
NOTICES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "neither the name of [^ ]+( [^ ]+){0,6} nor the names of its contributors"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "licensed under the apache", "licensed under the apache license( version 2 0)?( the license)? you may not use this file"),
    ("gpl", "free software you can", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved( this license| no part| unauthorized)"),
]


#: Signatures that are not of the families' form: label, keyword (in every match), tier, regex over words.
SIGNATURES = [
    ("gpl", "gplv", NAMED, "(gnu )?gplv[0-9]+"),
    ("gpl-1.0", "gplv1", VERSIONED, "(gnu )?gplv1( or later)?"),
    ("gpl-2.0", "gplv2", VERSIONED, "(gnu )?gplv2( 0)?( or later| only)?"),
    ("gpl-3.0", "gplv3", VERSIONED, "(gnu )?gplv3( 0)?( or later| only)?"),
    ("gpl-2.0", "gpl2", VERSIONED, "(gnu )?gpl2"),
    ("gpl-3.0", "gpl3", VERSIONED, "(gnu )?gpl3"),
    ("gpl-2.0", "gpl", VERSIONED, "gpl 2( 0)? (only|or later|or newer|or any later version)"),
    ("gpl-3.0", "gpl", VERSIONED, "gpl 3( 0)? (only|or later|or newer|or any later version)"),
    ("gpl-2.0", "either version 2", VERSIONED, "general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "either version 3", VERSIONED, "general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "version 2 of the gnu", VERSIONED, "version 2 of the gnu general public license"),
    ("gpl-3.0", "version 3 of the gnu", VERSIONED, "version 3 of the gnu general public license"),
    ("gpl", "general public licence", NAMED, "(gnu )?general public licence"),
    ("gpl", "gpl compatible", NAMED, "gpl compatible (free software )?licen[sc]e"),
    ("gpl-2.0-classpath", "classpath exception", VERSIONED, "(gnu )?classpath exception"),
    ("gpl-2.0-classpath", "gpl 2 0 with classpath", DECLARED, "gpl 2 0 with classpath exception 2 0"),
    ("gpl-linking", "linking exception", NAMED, "(gpl )?linking exception"),
    ("gpl-bison", "bison exception", NAMED, "bison exception"),
    ("gpl-autoconf", "autoconf exception", NAMED, "autoconf exception"),
    ("gpl-font", "font exception", NAMED, "(gpl )?font exception"),
    ("gcc-exception", "gcc runtime library exception", VERSIONED, "gcc runtime library exception"),
    ("linux-syscall-note", "linux syscall note", DECLARED, "gpl 2 0( only| or later)? with linux syscall note"),
    ("lgpl", "lgplv", NAMED, "(gnu )?lgplv[0-9]+"),
    ("lgpl-2.0", "lgplv2", VERSIONED, "(gnu )?lgplv2( 0)?"),
    ("lgpl-2.1", "lgplv2", VERSIONED, "(gnu )?lgplv2 1( or later| only)?"),
    ("lgpl-3.0", "lgplv3", VERSIONED, "(gnu )?lgplv3( 0)?( or later| only)?"),
    ("lgpl", "lesser gpl", NAMED, "(gnu )?lesser gpl"),
    ("lgpl", "library gpl", NAMED, "(gnu )?library gpl"),
    ("lgpl-2.1", "version 2 1 of the", VERSIONED, "either version 2 1 of the license or at your option any later version"),
    ("agpl", "agplv", NAMED, "(gnu )?agplv[0-9]+"),
    ("agpl-3.0", "agplv3", VERSIONED, "(gnu )?agplv3( or later| only)?"),
    ("agpl-3.0", "affero gpl", VERSIONED, "(gnu )?affero gpl (version |v)?3"),
    ("agpl", "affero gpl", NAMED, "(gnu )?affero gpl"),
    ("gfdl", "gfdl", NAMED, "(gnu )?gfdl"),
    ("gfdl", "fdl", NAMED, "gnu fdl"),
    ("gfdl", "no invariant sections", NAMED, "with no invariant sections( no front cover texts and no back cover texts)?"),
    ("apache-2.0", "apache 2", VERSIONED, "apache 2( 0)?"),
    ("apache-2.0", "apache2", VERSIONED, "apache2( 0)?( license)?"),
    ("apache-2.0", "apachev2", VERSIONED, "apachev2( license)?"),
    ("apache-2.0", "asl", VERSIONED, "asl (version )?2 0"),
    ("apache-2.0", "al2", VERSIONED, "al2 0"),
    ("apache", "licence", NAMED, "apache( software)? licence"),
    ("apache", "apache licensed", NAMED, "apache licensed"),
    ("apache-2.0", "apache", DECLARED, "licensed under the apache license version 2 0 the license"),
    ("apache", "apache", NAMED, "(dual )?licensed under (the )?apache"),
    ("apache-2.0", "llvm exception", DECLARED, "apache 2 0 with llvm exception(s)?"),
    ("apache", "apache software foundation", NAMED, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("mit", "mit licence", NAMED, "(the )?mit licence"),
    ("mit", "mit licensed", NAMED, "mit licensed"),
    ("mit", "mit", NAMED, "(licensed|released|distributed|available) under (the )?mit"),
    ("mit", "mit x11", NAMED, "(the )?mit x11( license| licence)?"),
    ("mit", "expat licence", NAMED, "(the )?expat licence"),
    ("mit", "license mit", DECLARED, "license mit"),
    ("mit", "the above copyright notice and this permission notice", NAMED, "the above copyright notice and this permission notice (shall|should) be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders", NAMED, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "mit 0", VERSIONED, "mit 0( license)?"),
    ("mit-0", "mit no attribution licence", NAMED, "mit no attribution licence"),
    ("mit-advertising", "mit with advertising", NAMED, "mit with advertising"),
    ("mit-apache", "mit or apache", NAMED, "mit or apache( license)?( 2 0)?"),
    ("mit-apache", "apache 2 0 or mit", NAMED, "apache 2 0 or mit( license)?"),
    ("bsd", "licence", NAMED, "bsd( style)? licence"),
    ("bsd", "bsd licensed", NAMED, "bsd licensed"),
    ("bsd", "bsd like", NAMED, "bsd like licen[sc]e"),
    ("bsd", "berkeley software distribution", NAMED, "berkeley software distribution( license)?"),
    ("bsd", "bsd", NAMED, "(licensed|released|distributed|available) under (the )?bsd"),
    ("bsd-1-clause", "bsd 1", VERSIONED, "bsd 1 clause( licen[sc]e)?"),
    ("bsd-2-clause", "bsd 2", VERSIONED, "bsd 2 clause( licen[sc]e)?"),
    ("bsd-2-clause", "bsd two", VERSIONED, "bsd two clause( licen[sc]e)?"),
    ("bsd-2-clause", "clause bsd", VERSIONED, "(2|two) clause bsd"),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent", VERSIONED, "bsd 2 clause plus patent( license)?"),
    ("bsd-3-clause", "bsd 3", VERSIONED, "bsd 3 clause( licen[sc]e)?"),
    ("bsd-3-clause", "bsd three", VERSIONED, "bsd three clause( licen[sc]e)?"),
    ("bsd-3-clause", "clause bsd", VERSIONED, "(3|three) clause bsd"),
    ("bsd-3-clause-clear", "bsd 3 clause clear", VERSIONED, "bsd 3 clause clear( license)?"),
    ("bsd-3-clause", "bsd3", VERSIONED, "bsd3"),
    ("bsd-2-clause", "bsd2", VERSIONED, "bsd2"),
    ("bsd-4-clause", "bsd 4", VERSIONED, "bsd 4 clause( licen[sc]e)?"),
    ("bsd-4-clause", "all advertising materials", NAMED, "all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("bsd", "redistributions of source code", NAMED, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", NAMED, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "regents of the university", NAMED, "copyright( c)?( [0-9]+)* the regents of the university of california"),
    ("bsd-protection", "bsd protection", NAMED, "bsd protection license"),
    ("0bsd", "free public license", VERSIONED, "free public license 1 0 0"),
    ("isc", "isc licence", NAMED, "isc licence"),
    ("isc", "isc licensed", NAMED, "isc licensed"),
    ("isc", "internet systems consortium", NAMED, "internet systems consortium( inc)?( license)?"),
    ("isc", "the software is provided as is and", NAMED, "the software is provided as is and (isc|the author) disclaims all warranties"),
    ("mpl", "mozilla public licence", NAMED, "mozilla public licence"),
    ("mpl-1.1", "mplv1", VERSIONED, "mplv1 1"),
    ("mpl-2.0", "mplv2", VERSIONED, "mplv2( 0)?"),
    ("mpl-2.0", "mpl2", VERSIONED, "mpl2"),
    ("mpl-2.0", "incompatible with secondary licenses", VERSIONED, "incompatible with secondary licenses"),
    ("mpl", "subject to the mozilla", NAMED, "the contents of this file are subject to the mozilla public license"),
    ("npl", "netscape public", NAMED, "netscape public license( version)?( 1 [01])?"),
    ("epl", "eclipse public licence", NAMED, "eclipse public licence"),
    ("epl-1.0", "eplv1", VERSIONED, "eplv1( 0)?"),
    ("epl-2.0", "eplv2", VERSIONED, "eplv2( 0)?"),
    ("epl", "accompanying materials", NAMED, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "cddlv1", VERSIONED, "cddlv1( [01])?"),
    ("cpl", "cpl", VERSIONED, "cpl (version |v)?1 0"),
    ("ipl", "ibm public", NAMED, "ibm public license( version)?( 1 0)?"),
    ("spl", "sun public", NAMED, "sun public license( version)?( 1 0)?"),
    ("sissl", "sun industry standards", NAMED, "sun industry standards source license"),
    ("eupl-1.1", "euplv1", VERSIONED, "euplv1 1"),
    ("eupl-1.2", "euplv1", VERSIONED, "euplv1 2"),
    ("eupl", "licensed under the eupl", DECLARED, "licensed under the eupl( version| v)?( 1 [012])?( or later)?"),
    ("artistic", "artistic licence", NAMED, "artistic licence"),
    ("artistic-perl", "perl artistic", NAMED, "(clarified )?perl artistic license"),
    ("artistic-clarified", "clarified artistic", NAMED, "clarified artistic license"),
    ("bsl-1.0", "boost license", VERSIONED, "boost license( version)?( 1 0)?"),
    ("bsl-1.0", "bsl 1 0", VERSIONED, "bsl 1 0"),
    ("busl", "busl", VERSIONED, "busl 1 1"),
    ("busl", "business source license", NAMED, "business source license( 1 1)? change (date|license)"),
    ("sspl", "sspl", VERSIONED, "sspl( 1 0| v1)?"),
    ("elastic-2.0", "elv2", VERSIONED, "elv2"),
    ("commons-clause", "commons clause", NAMED, "commons clause( license)?( condition)?( v1 0)?"),
    ("confluent", "confluent community", NAMED, "confluent community license( agreement)?"),
    ("timescale", "timescale license", NAMED, "timescale license( agreement)?"),
    ("polyform", "polyform", NAMED, "polyform (noncommercial|small business|shield|perimeter|strict|free trial|internal use)( license)?( 1 0 0)?"),
    ("parity", "parity public", NAMED, "parity public license"),
    ("hippocratic", "hippocratic", NAMED, "hippocratic license( [0-9] [0-9])?"),
    ("json", "shall be used for good", VERSIONED, "the software shall be used for good not evil"),
    ("json", "json license", NAMED, "json license"),
    ("zlib", "zlib", NAMED, "zlib licence"),
    ("zlib", "altered source versions", NAMED, "altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software", NAMED, "the origin of this software must not be misrepresented"),
    ("bzip2", "bzip2 license", NAMED, "bzip2 license( 1 0 [56])?"),
    ("libtiff", "libtiff license", NAMED, "libtiff license"),
    ("ijg", "independent jpeg group", NAMED, "independent jpeg group( s software| license)?"),
    ("freetype", "freetype", NAMED, "freetype (project )?license"),
    ("imagemagick", "imagemagick license", NAMED, "imagemagick license"),
    ("openssl", "openssl project", NAMED, "this product includes software developed by the openssl project"),
    ("ssleay", "ssleay license", NAMED, "(original )?ssleay license"),
    ("openldap", "openldap public", NAMED, "openldap public license( version)?( 2 [0-9])?"),
    ("python", "python software foundation", NAMED, "python software foundation licen[sc]e( agreement)?"),
    ("python-2.0", "psf 2", VERSIONED, "psf 2 0"),
    ("cnri-python", "cnri", NAMED, "cnri (open source )?(license|python license)( agreement)?"),
    ("zpl", "zope public", NAMED, "zope public license( zpl)?( version)?( [12] [01])?"),
    ("php", "this product includes php", NAMED, "this product includes php software"),
    ("tcl", "tcl tk license", NAMED, "tcl tk license( terms)?"),
    ("lua", "lua license", NAMED, "lua license"),
    ("postgresql", "postgresql global development group", NAMED, "portions copyright( c)?( [0-9]+)* postgresql global development group"),
    ("sqlite-blessing", "may you do good", NAMED, "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("unicode", "unicode inc", NAMED, "unicode inc license agreement( data files and software)?"),
    ("icu", "icu license", NAMED, "icu license( icu 1 8 1 and later)?"),
    ("w3c", "w3c software", NAMED, "w3c software and document (notice and )?license"),
    ("w3c", "w3c document", NAMED, "w3c document license"),
    ("ofl-1.1", "sil ofl", VERSIONED, "sil ofl( version)?( 1 1)?"),
    ("ofl", "reserved font name", NAMED, "with reserved font name( s)?"),
    ("ufl", "ubuntu font", NAMED, "ubuntu font licen[sc]e( version)?( 1 0)?"),
    ("lppl", "latex project public", NAMED, "latex project public license( version)?( 1 [0-3][abc]?)?"),
    ("lppl", "lppl", NAMED, "lppl( version)?( 1 [0-3][abc]?)?"),
    ("odbl", "odbl", NAMED, "odbl( v?1 0)?"),
    ("odc-by", "odc by", NAMED, "odc by( 1 0| v1 0)?"),
    ("cdla-permissive", "cdla permissive", VERSIONED, "cdla permissive( version)?( [12] 0)?"),
    ("cdla-permissive", "community data license", NAMED, "community data license agreement permissive( version)?( [12] 0)?"),
    ("cdla-sharing", "cdla sharing", VERSIONED, "cdla sharing( 1 0)?"),
    ("cdla-sharing", "community data license", NAMED, "community data license agreement sharing( version)?( 1 0)?"),
    ("c-uda", "computational use of data", NAMED, "computational use of data agreement"),
    ("openrail", "openrail", NAMED, "((creative ml|bigscience|bigcode|code) )?openrail(( [a-z]){0,2})( license)?"),
    ("rail", "bloom rail", NAMED, "(bigscience )?bloom rail( license)?( 1 0)?"),
    ("llama", "llama", NAMED, "llama [23]( [0-9])?( community)? license( agreement)?"),
    ("gemma", "gemma terms of use", NAMED, "gemma terms of use"),
    ("cc0", "cc0", DECLARED, "cc0 1 0( universal)?( public domain dedication)?"),
    ("cc0", "creative commons zero", NAMED, "creative commons zero( v?1 0)?( universal)?"),
    ("cc0", "no rights reserved", NAMED, "no rights reserved"),
    ("cc0", "waived all copyright", NAMED, "waived all copyright and related or neighboring rights"),
    ("cc-by", "creative commons by", NAMED, "creative commons by"),
    ("cc-by", "attribution 4 0 international", VERSIONED, "attribution 4 0 international"),
    ("cc-by-sa", "creative commons by sa", NAMED, "creative commons by sa"),
    ("cc-by-sa", "attribution sharealike", NAMED, "attribution sharealike( [1-4] [05])?( international| unported)?"),
    ("cc-by-nc", "attribution noncommercial", NAMED, "attribution noncommercial( [1-4] [05])?( international| unported)?"),
    ("cc-by-nd", "creative commons", NAMED, "creative commons attribution no ?deriv(ative)?s( [1-4] [05])?( license)?"),
    ("cc-by-nd", "attribution noderivatives", NAMED, "attribution noderivatives( [1-4] [05])?( international| unported)?"),
    ("cc-by-nc-sa", "creative commons", NAMED, "creative commons attribution non ?commercial share ?alike( [1-4] [05])?( license| international| unported)?"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", NAMED, "attribution noncommercial sharealike( [1-4] [05])?( international| unported)?"),
    ("cc-by-nc-nd", "creative commons", NAMED, "creative commons attribution non ?commercial no ?deriv(ative)?s( [1-4] [05])?( license| international| unported)?"),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives", NAMED, "attribution noncommercial noderivatives( [1-4] [05])?( international| unported)?"),
    ("cc-sampling", "sampling plus", NAMED, "creative commons sampling plus( 1 0)?"),
    ("public-domain", "in the public domain", NAMED, "(is|are|was|were) in the public domain"),
    ("public-domain", "disclaims copyright", NAMED, "the author disclaims copyright to this source code"),
    ("public-domain", "public domain mark", NAMED, "public domain mark( 1 0)?"),
    ("wtfpl", "do what the fuck", NAMED, "do what the fuck you want to( public license)?"),
    ("beerware", "beer ware", NAMED, "(the )?beer ware license( revision 42)?"),
    ("beerware", "buy me a beer", NAMED, "you can buy me a beer in return"),
    ("ms-pl", "ms pl", VERSIONED, "ms pl"),
    ("ms-rl", "ms rl", VERSIONED, "ms rl"),
    ("ms-lpl", "microsoft limited public", NAMED, "microsoft limited public license"),
    ("apsl", "apsl", VERSIONED, "apsl( version)?( [12] [0-2])?"),
    ("ncsa", "university of illinois", NAMED, "university of illinois open source license"),
    ("ecl", "educational community", NAMED, "educational community license( version)?( [12] 0)?"),
    ("afl", "afl", VERSIONED, "afl (version |v)?[123] [01]"),
    ("osl-3.0", "osl", VERSIONED, "osl (version |v)?3 0"),
    ("upl", "universal permissive", NAMED, "universal permissive license( upl)?( version| v)?( 1 0)?"),
    ("cpal", "common public attribution", NAMED, "common public attribution license( version)?( 1 0)?"),
    ("qpl", "q public license", NAMED, "q public license( version)?( 1 0)?"),
    ("rpl", "reciprocal public", NAMED, "reciprocal public license( [0-9] [0-9])?"),
    ("sleepycat", "sleepycat license", NAMED, "sleepycat license"),
    ("intel", "intel open source", NAMED, "intel open source license"),
    ("nasa", "nasa open source", NAMED, "nasa open source agreement( 1 3)?"),
    ("cern-ohl", "cern open hardware", NAMED, "cern open hardware licen[sc]e( version)?( [12])?"),
    ("cern-ohl", "cern ohl", NAMED, "cern ohl( [psw])?( 2 0)?"),
    ("solderpad", "solderpad hardware", NAMED, "solderpad hardware licen[sc]e"),
    ("tapr-ohl", "tapr open hardware", NAMED, "tapr open hardware license"),
    ("mulan", "mulan psl", NAMED, "mulan psl( v?2)?"),
    ("mulan", "mulan permissive", NAMED, "mulan permissive software license( v?[12])?"),
    ("etalab", "licence ouverte", NAMED, "licence ouverte( open licence)?( etalab)?( 2 0)?"),
    ("ogl", "contains public sector information", NAMED, "contains public sector information licensed under the open government licen[sc]e"),
    ("ogc", "ogc software", NAMED, "ogc software (notice|license)( 1 0)?"),
    ("proprietary", "proprietary and confidential", NAMED, "proprietary and confidential( all rights reserved)?"),
    ("proprietary", "unauthorized copying", NAMED, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "end user license", NAMED, "end user license agreement"),
    ("proprietary", "eula", NAMED, "eula"),
]


def rules() -> list[tuple[str, int, int, str, str]]:
    """(keyword, tier, order, label, regex) of every rule, most telling first. Each regex starts at a
    space and ends before one."""
    out = []
    for label, keyword, name, versions, address in FAMILIES:
        tag = label.replace("-", " ")
        if address:
            out.append((address.split(" ")[0].strip("("), DECLARED, label, f" {address}"))
        out.append(("spdx", DECLARED, label, f" spdx license identifier {tag}"))
        for v in versions:
            major, _, minor = v.partition(" ")
            number = f"{major}( {minor})?" if minor == "0" else f"{major} {minor}"
            full = f"{label}-{v.replace(' ', '.')}"
            out.append(("spdx", DECLARED, full, f" spdx license identifier {tag} {v}( only| or later)?"))
            out.append((keyword, VERSIONED, full, f" {name}( version| v| ver)? {number}"))
            out.append((keyword, VERSIONED, full, f" {name}( license)? v{major}( {minor})?"))
        out.append((keyword, NAMED, label, f" {name}"))
        out.append((keyword, NAMED, label, f" (licensed|released|distributed|available) under (the )?(terms of )?(the )?{name}"))
    out += [(keyword, NAMED, label, f" {regex}") for label, keyword, regex in NOTICES]
    out += [(keyword, tier, label, f" {regex}") for label, keyword, tier, regex in SIGNATURES]
    return [(k, tier, i, label, f"{regex}(?= )") for i, (k, tier, label, regex) in enumerate(sorted(out, key=lambda r: -r[1]))]


#: Stands for what a class, a repetition or the like may match.
ANY = "\0"
#: Words too common to call up a rule by, if the rule has another.
COMMON = set(
    "agreement altered attribution available be beer by clause clear code common commons contributors copies copying copyright creative data development distribute distributed distribution document documents domain exception following font for form four free "
    "general good group identifier included includes independent international invariant in is it liability library license licensed licenses limited made materials name no not notice of on open origin original part permission permissive project public purpose released "
    "reserved return rights runtime same scripts sections shall sharing software source terms that the this three to two under university unlimited unmodified use used version versions was were what with work zero".split()
)


def _spellings(regex: str, i: int = 0) -> tuple[set[str], int]:
    """What the regex matches from its i-th character to the end of the group, ANY where that is not
    spelt out; and the place of that end."""
    done: set[str] = set()
    sofar = {""}
    while i < len(regex) and regex[i] != ")":
        c = regex[i]
        if c == "|":
            done, sofar, i = done | sofar, {""}, i + 1
            continue
        if c == "(":
            part, i = _spellings(regex, i + 1)
        elif c == "[":
            i, inside = regex.index("]", i), regex[i + 1 : regex.index("]", i)]
            part = set(inside) if inside.isalnum() else {ANY}
        else:
            part = {ANY if c == "." else c}
        i += 1
        after = regex[i : i + 1]
        if after == "?":
            part, i = part | {""}, i + 1
        elif after in ("*", "+"):
            part, i = {ANY} | ({""} if after == "*" else set()), i + 1
        elif after == "{":
            part, i = {"", ANY}, regex.index("}", i) + 1
        sofar = {x + y for x in sofar for y in part}
    return done | sofar, i


def _held(spelling: str) -> set[str]:
    """Phrases in every line that holds the spelling: from a space on, up to a space or what is not spelt out."""
    out = set()
    for part in f"{spelling} ".split(ANY):
        cuts = [k for k, c in enumerate(part) if c == " "]
        out |= {part[i : j + 1] for i in cuts for j in cuts if j > i} | {part[i:] for i in cuts if i + 1 < len(part)}
    return out


def _telling(word: str) -> bool:
    return word not in COMMON and not re.fullmatch("v?[0-9]*|.", word)


def _anchor(phrase: str) -> str:
    """The word of the phrase, or start of a word, that is likely the rarest."""
    return max(phrase.split(), key=lambda x: (_telling(x), len(x)))


@functools.cache
def _calls() -> dict[str, list[tuple[str, list[int]]]]:
    """By anchor, the phrases with that anchor and the rules called up by them: every match of a rule holds
    one of the phrases that call it up. An anchor also has the phrases of those that it starts with."""
    worth = lambda p: (_telling(_anchor(p)), len(p), p)
    called: dict[str, list[int]] = {f" {p} ": [] for p, _ in BASE}
    for _, _, order, _, regex in rules():
        each = [_held(x) for x in _spellings(regex.removesuffix("(?= )"))[0]]
        shared, own = max(set.intersection(*each), key=worth, default=None), {max(x, key=worth) for x in each}
        for p in {shared} if shared and worth(shared)[0] >= min(map(worth, own))[0] else own:
            called.setdefault(p, []).append(order)
    anchors = {_anchor(p) for p in called}
    return {a: [(p, orders) for p, orders in sorted(called.items()) if a.startswith(_anchor(p)) and (a == _anchor(p) or not p.endswith(" ") and _anchor(p) == p.split()[-1])] for a in sorted(anchors)}


def _trie(ends: list[str]) -> str:
    """A regex for any of the strings, the longest first; a space at the end is only looked at."""
    by: dict[str, list[str]] = {}
    for x in ends:
        if x:
            by.setdefault(x[0], []).append(x[1:])
    found = ["(?= )" if c == " " else c + _trie(rest) for c, rest in sorted(by.items(), reverse=True)] + ([""] if "" in ends else [])
    return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"


@functools.cache
def _anchors() -> str:
    """A regex for a space and any anchor: whole words, and those that a phrase ends in, as starts of words."""
    return f" ({_trie(sorted({a if not p.endswith(' ') and p.split()[-1] == a else f'{a} ' for a, phrases in _calls().items() for p, _ in phrases if _anchor(p) == a}))})"


def _called(hits: Column, line: Column) -> Column:
    """Orders of the rules that the anchors in a line call up and that may match it."""
    table = F.from_json(F.lit(json.dumps({a: [{"phrase": p, "rules": r} for p, r in phrases] for a, phrases in _calls().items()})), "map<string,array<struct<phrase:string,rules:array<int>>>>")
    phrases = F.flatten(F.transform(hits, lambda a: F.element_at(table, a)))
    return F.array_distinct(F.flatten(F.transform(F.filter(phrases, lambda p: F.contains(line, p["phrase"])), lambda p: p["rules"])))


def _places(w: Column, phrase: str) -> Column:
    """Word places where the phrase stands."""
    said = phrase.split(" ")
    there = lambda i: F.forall(F.array(*[F.get(w, i + k) == said[k] for k in range(len(said))]), lambda x: x)
    return F.when(F.size(w) >= len(said), F.filter(F.sequence(F.lit(0), F.size(w) - len(said)), there)).otherwise(F.array().cast("array<int>"))


def _lengths(line: Column, regex: Column) -> Column:
    """(gap, hit): lengths of each match and of what lies before it."""
    between, hits = F.split(line, regex, -1), F.regexp_extract_all(line, regex, F.lit(0))
    # both are arguments, which are worked out once; within the function they would be for each match
    lengths = F.zip_with(between, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    return F.filter(lengths, lambda x: x["hit"].isNotNull())


def detections(lines: DataFrame) -> DataFrame:
    """(rid, label, tier): what stays of the matches of the called rules in (rid, line, called)."""
    # one row to start from; the rules are one literal, which is planned faster than a struct for each
    literal = json.dumps([dict(zip(("tier", "order", "label", "regex"), r[1:])) for r in rules()])
    listed = F.inline(F.from_json(F.lit(literal), "array<struct<tier:int,order:int,label:string,regex:string>>"))
    signatures = lines.sparkSession.range(1).select(listed)
    found = lines.select("rid", "line", F.explode("called").alias("order")).join(F.broadcast(signatures), "order")
    found = found.select("rid", "tier", "order", "label", F.posexplode(_lengths(F.col("line"), F.col("regex"))).alias("i", "x"))
    # (start, end) of each match, the leading space left out; a fold over an array would copy it for each match
    end = F.sum(F.col("x.gap") + F.col("x.hit")).over(Window.partitionBy("rid", "order").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    found = found.repartition("rid").withColumn("end", end).withColumn("start", F.col("end") - F.col("x.hit") + 1)
    before = Window.partitionBy("rid").orderBy("start", F.desc("end"), F.desc("tier"), "order").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.coalesce(F.max(F.when(F.col("tier") >= t, F.col("end"))).over(before), F.lit(-1)) for t in (NAMED, VERSIONED, DECLARED)]
    found = found.withColumns({f"reach{t}": r for t, r in zip((NAMED, VERSIONED, DECLARED), reach)})
    covered = F.when(F.col("tier") == NAMED, F.col("reach1")).when(F.col("tier") == VERSIONED, F.col("reach2")).otherwise(F.col("reach3")) >= F.col("end")
    return found.where(~covered).select("rid", "label", "tier")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # of texts in ASCII alone, lower() does the same and is faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(C.ascii_lower(text))
    rows = C.settled(docs).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.regexp_replace(low, F.lit(BETWEEN), F.lit(" "))).alias("said"))
    said = F.col("said")
    n_words = F.when(said == "", 0).otherwise(F.octet_length(said) - F.octet_length(F.replace(said, F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("rid", "doc_id", n_words.cast("long").alias("n_words"), F.concat(F.lit(" "), said, F.lit(" ")).alias("line"))
    rows = rows.select("*", F.array_distinct(F.regexp_extract_all("line", F.lit(_anchors()), F.lit(1))).alias("hits"))
    based = [(F.size("hits") > 0) & F.contains("line", F.lit(f" {p} ")) for p, _ in BASE]
    rows = rows.select("rid", "doc_id", "n_words", "line", _called(F.col("hits"), F.col("line")).alias("called"), F.when(functools.reduce(Column.__or__, based), F.split(F.trim("line"), " ")).alias("w"))
    w, none = F.col("w"), F.array().cast("array<int>")
    rows = rows.select(
        "rid", "doc_id", "n_words", F.when(F.size("called") > 0, F.col("line")).alias("line"), "called",
        *[F.when(w.isNotNull() & F.contains("line", F.lit(f" {p} ")), _places(w, p)).otherwise(none).alias(f"p{i}") for i, (p, _) in enumerate(BASE)],
    )
    places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    labels = F.array_sort(F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull()))
    rows = rows.select("rid", "doc_id", "n_words", "line", "called", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), labels.alias("base"))
    rows = C.stage(rows, "scanned")
    found = detections(rows.where("line IS NOT NULL").select("rid", "line", "called")).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("tier").alias("tier"))
    out = rows.drop("line", "called").join(found, "rid", "left")
    none = F.array().cast("array<string>")
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), F.col("tier")), F.when(F.size("base") > 0, BASE_SCORE), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none))))).alias("labels"), score.alias("score"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(C.table(spark, sf_dir, "documents"))
