"""License detection by ordered signature rules.

A text becomes its lower-cased words with one space between them. A keyword
prefilter, one automaton of all keywords, decides which rules run: a rule's
pattern is searched only in texts that hold its keyword. Detections are resolved in the rules' order: by
priority, then the longer one, then the earlier one; a detection inside an
interval that is already kept is suppressed. Base phrases keep their label
whatever the rules add.

One text at a time and no exchange; memory is bounded by the longest text,
and the cost is that of n log n in its detections.
Defined results: a null or empty text has no words, labels or score; ties go
to the rule that comes first; repeated rows are scanned each; an empty table
gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import ALNUM_TABLE, map_arrow, narrow

#: The phrases of the contract and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """A signature: what it says about the text, its order, the word that lets it run, its pattern, how sure it is."""

    label: str
    priority: int
    keyword: str
    pattern: str
    score: float


#: Families with versions: label stem, names in words, short names, versions.
VERSIONED = (
    ("gpl", ("gnu general public licen[cs]e", "gnu gpl", "general public licen[cs]e"), ("gpl",), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "lesser general public licen[cs]e", "gnu lgpl"), ("lgpl",), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public licen[cs]e", "affero general public licen[cs]e", "gnu agpl"), ("agpl",), ("1", "3")),
    ("gfdl", ("gnu free documentation licen[cs]e", "free documentation licen[cs]e"), ("gfdl",), ("1 1", "1 2", "1 3")),
    ("apache", ("apache software licen[cs]e", "apache licen[cs]e"), ("asl",), ("1", "1 1", "2")),
    ("mpl", ("mozilla public licen[cs]e",), ("mpl",), ("1", "1 1", "2")),
    ("epl", ("eclipse public licen[cs]e",), ("epl",), ("1", "2")),
    ("cddl", ("common development and distribution licen[cs]e",), ("cddl",), ("1", "1 1")),
    ("eupl", ("european union public licen[cs]e",), ("eupl",), ("1", "1 1", "1 2")),
    ("osl", ("open software licen[cs]e",), ("osl",), ("1", "2", "2 1", "3")),
    ("afl", ("academic free licen[cs]e",), ("afl",), ("1 1", "1 2", "2", "2 1", "3")),
    ("artistic", ("artistic licen[cs]e",), (), ("1", "2")),
    ("cpl", ("common public licen[cs]e",), (), ("1",)),
    ("bsl", ("boost software licen[cs]e",), (), ("1",)),
    ("ofl", ("sil open font licen[cs]e", "open font licen[cs]e"), ("ofl",), ("1", "1 1")),
    ("lppl", ("latex project public licen[cs]e",), ("lppl",), ("1", "1 2", "1 3")),
    ("odbl", ("open database licen[cs]e",), ("odbl",), ("1",)),
    ("ncsa", ("university of illinois ncsa open source licen[cs]e", "ncsa open source licen[cs]e"), (), ()),
    ("psf", ("python software foundation licen[cs]e",), (), ("2",)),
    ("ms-pl", ("microsoft public licen[cs]e",), (), ()),
    ("zlib", ("zlib libpng licen[cs]e", "zlib licen[cs]e"), (), ()),
    ("isc", ("isc licen[cs]e", "internet systems consortium licen[cs]e"), (), ()),
    ("mit", ("mit licen[cs]e", "x11 licen[cs]e", "mit x11 licen[cs]e", "expat licen[cs]e"), (), ()),
    ("unlicense", ("the unlicense",), (), ()),
    ("wtfpl", ("do what the fuck you want to public licen[cs]e", "wtfpl"), (), ("1", "2")),
    ("vim", ("vim licen[cs]e",), (), ()),
    ("php", ("php licen[cs]e",), (), ("3", "3 1")),
    ("ruby", ("ruby licen[cs]e",), (), ()),
    ("postgresql", ("postgresql licen[cs]e",), (), ()),
)

#: Sentences of license texts and notices, written out in normalised words: label, keyword, pattern, how sure it is.
SENTENCES = (
    # mit, x11 and their kin
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 1.0),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "infringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement", 0.6),
    ("mit", "authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.8),
    ("mit", "mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?", 1.0),
    ("mit", "mit", r"mit (?:style|like) licen[cs]e", 0.7),
    ("mit", "opensource org", r"opensource org licenses mit(?: license)?(?: php)?", 1.0),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", 1.0),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("mit-modern", "modern variant", r"mit licen[cs]e modern variant", 1.0),
    # isc, ntp, historical permissions
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "author disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 0.9),
    ("isc", "tortious action", r"whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", 0.8),
    ("ntp", "documentation for any purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted", 1.0),
    ("hpnd", "specific written prior permission", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", 1.0),
    ("0bsd", "zero clause", r"(?:bsd zero clause|zero clause bsd)(?: licen[cs]e)?", 1.0),
    # bsd
    ("bsd-2-clause", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-2-clause", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-2-clause", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-3-clause", "endorse or promote", r"redistribution and use in source and binary forms (?:\w+ ){0,120}?endorse or promote products", 1.0),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:\w+ ){1,14}?may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-3-clause", "endorse or promote", r"the names? of (?:\w+ ){1,14}?may not be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 1.0),
    ("bsd", "bsd", r"(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: licen[cs]e)?", 0.9),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", 0.7),
    ("bsd", "regents and contributors", r"this software is provided by the regents and contributors as is", 0.9),
    ("bsd", "regents of the university", r"the regents of the university of california all rights reserved", 0.8),
    ("bsd-2-clause-patent", "patent", r"bsd 2 clause plus patent(?: licen[cs]e)?", 1.0),
    ("bsd-2-clause-views", "official policies", r"should not be interpreted as representing official policies either expressed or implied", 0.9),
    ("bsd-3-clause", "opensource org", r"opensource org licenses bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource org", r"opensource org licenses bsd 2 clause", 1.0),
    ("bsd", "opensource org", r"opensource org licenses bsd license(?: php)?", 0.9),
    # apache
    ("apache-2", "apache", r"licensed under the apache licen[cs]e version 2 0", 1.0),
    ("apache-2", "apache org", r"www apache org licenses license 2 0", 1.0),
    ("apache-2", "in compliance with the license", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.9),
    ("apache-2", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "governing permissions", r"see the license for the specific language governing permissions and limitations under the license", 0.9),
    ("apache-2", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-2", "copyright license", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 1.0),
    ("apache-2", "such litigation is filed", r"then any patent licenses granted to you under this license for that work shall terminate as of the date such litigation is filed", 0.9),
    ("apache-2", "apache", r"(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: licen[cs]e)? (?:version )?2(?: 0)?", 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-1", "apache group", r"this product includes software developed by the apache group for use in the apache http server project", 1.0),
    # gpl, lgpl, agpl, gfdl
    ("gpl-or-later", "any later version", r"either version \d of the license or (?:at your option )?any later version", 0.9),
    ("gpl", "free software foundation", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation", 1.0),
    ("gpl-2-only", "version 2", r"under the terms of (?:the )?gnu general public licen[cs]e version 2 (?:only )?as published by the free software foundation", 1.0),
    ("gpl-2-only", "version 2", r"under the terms of version 2 of the gnu general public licen[cs]e", 1.0),
    ("gpl-3-only", "version 3", r"under the terms of (?:the )?gnu general public licen[cs]e version 3 (?:only )?as published by the free software foundation", 1.0),
    ("gpl-3-only", "version 3", r"under the terms of version 3 of the gnu general public licen[cs]e", 1.0),
    ("gpl", "without any warranty", r"in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[cs]e along with this program", 1.0),
    ("gpl", "gnu org licenses", r"gnu org licenses gpl(?: \d 0)?", 0.9),
    ("gpl", "freedom to share", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change", 1.0),
    ("gpl-3", "copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("gpl-2", "copying distribution and modification", r"terms and conditions for copying distribution and modification", 0.8),
    ("gpl", "gpl", r"(?:released|licensed|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl", 0.9),
    ("gpl-classpath-exception", "classpath", r"(?:classpath exception|gpl with classpath exception|subject to the classpath exception)", 1.0),
    ("gpl-linking-exception", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library", 1.0),
    ("gpl-gcc-exception", "runtime library exception", r"gcc runtime library exception", 1.0),
    ("gpl-font-exception", "font exception", r"(?:gpl|gnu general public licen[cs]e) with (?:the )?font exception", 1.0),
    ("gpl-syscall-note", "linux syscall note", r"with linux syscall note", 1.0),
    ("lgpl", "general public", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation", 1.0),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this", 1.0),
    ("lgpl", "library general public", r"you should have received a copy of the gnu library general public licen[cs]e along with this", 1.0),
    ("lgpl", "gnu org licenses", r"gnu org licenses lgpl(?: \d \d)?", 0.9),
    ("lgpl-2.1", "successor of the gnu library", r"the first released version of the lesser gpl it also counts as the successor of the gnu library public license", 1.0),
    ("agpl", "affero general public", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", 1.0),
    ("agpl", "affero general public", r"you should have received a copy of the gnu affero general public licen[cs]e along with this", 1.0),
    ("agpl-3", "interacting with it remotely", r"interacting with it remotely through a computer network", 0.8),
    ("agpl", "gnu org licenses", r"gnu org licenses agpl(?: \d 0)?", 0.9),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("gfdl-no-invariants", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 0.9),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl", 0.9),
    ("gnu-all-permissive", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
    # weak copyleft
    ("mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0", 1.0),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 1.0),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 1.0),
    ("mpl-1.1", "mozilla org", r"mozilla org mpl mpl 1 1", 1.0),
    ("npl-1.1", "netscape public", r"the contents of this file are subject to the netscape public licen[cs]e version 1 1", 1.0),
    ("mpl-2-no-copyleft", "incompatible with secondary", r"this source code form is incompatible with secondary licenses as defined by the mozilla public licen[cs]e", 1.0),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10", 1.0),
    ("epl-2", "eclipse org", r"eclipse org legal epl (?:2 0|v20)", 1.0),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public licen[cs]e", 0.9),
    ("epl", "accompanying program", r"the accompanying program is provided under the terms of this (?:eclipse|common) public licen[cs]e agreement", 0.9),
    ("cddl", "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1.0),
    ("cddl", "opensolaris", r"you can obtain a copy of the license at usr src opensolaris license", 1.0),
    ("cpl-1", "common public", r"made available under the terms of the common public licen[cs]e", 1.0),
    ("ipl-1", "ibm public", r"ibm public licen[cs]e(?: version)? 1 0", 1.0),
    ("spl-1", "sun public", r"sun public licen[cs]e(?: version)? 1 0", 1.0),
    ("apsl-2", "apple public source", r"apple public source licen[cs]e(?: version)? 2 0", 1.0),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", 1.0),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("eupl", "eupl", r"licensed under the eupl", 0.9),
    ("cecill", "cecill", r"governed by the cecill(?: [bc])? licen[cs]e under french law", 1.0),
    ("cecill", "cecill", r"cecill(?: [bc])? (?:free software )?licen[cs]e(?: agreement)?", 0.9),
    ("qpl-1", "q public", r"q public licen[cs]e(?: version)?(?: 1 0)?", 1.0),
    ("artistic", "the intent of this document", r"the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic-perl", "same terms as perl", r"(?:under|on) the same terms as perl itself", 1.0),
    ("lppl", "latex project public", r"this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", 1.0),
    ("lppl", "lppl", r"this work has the lppl maintenance status", 0.9),
    ("osl-3", "open software", r"licensed under the open software licen[cs]e version 3 0", 1.0),
    ("afl-3", "academic free", r"licensed under the academic free licen[cs]e version 3 0", 1.0),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[cs]e(?: version)?(?: 1 5)?", 1.0),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", 1.0),
    ("simpl-2", "simple public", r"simple public licen[cs]e(?: 2 0)?", 0.9),
    ("upl-1", "universal permissive", r"universal permissive licen[cs]e(?: upl)?(?: v(?:ersion)? ?1 0)?", 1.0),
    ("ecl-2", "educational community", r"educational community licen[cs]e(?: version)?(?: 2 0)?", 1.0),
    ("w3c", "w3c software", r"w3c software (?:notice and )?licen[cs]e", 1.0),
    ("mulan-psl", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v ?\d)?", 1.0),
    # permissive others
    ("zlib", "express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1.0),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("libpng", "libpng", r"libpng versions? (?:\w+ ){1,12}?are copyright", 0.9),
    ("boost-1", "boost", r"distributed under the boost software licen[cs]e", 1.0),
    ("boost-1", "boost org", r"boost org license 1 0(?: txt)?", 1.0),
    ("boost-1", "machine executable object code", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", 1.0),
    ("ncsa", "to deal with the software", r"to deal with the software without restriction including without limitation", 0.9),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 1.0),
    ("curl", "daniel stenberg", r"copyright (?:c )?(?:\d{4} )+daniel stenberg", 0.8),
    ("icu", "icu licen", r"icu licen[cs]e", 0.9),
    ("unicode", "unicode inc", r"unicode inc licen[cs]e agreement data files and software", 1.0),
    ("unicode", "unicode data files", r"a copy of the unicode data files and any associated documentation", 1.0),
    ("psf-2", "python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization", 1.0),
    ("python", "beopen", r"beopen python open source licen[cs]e agreement", 1.0),
    ("postgresql", "university of california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", 1.0),
    ("tcl", "authors hereby grant", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation", 1.0),
    ("naist-2003", "nara institute", r"nara institute of science and technology", 0.6),
    ("ruby", "2 clause bsdl", r"you may redistribute it and or modify it under either the terms of the 2 clause bsdl", 1.0),
    ("php-3.1", "php software", r"this product includes php software freely available from", 1.0),
    ("vim", "vim", r"vim is charityware", 0.9),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group", 1.0),
    ("freetype", "freetype", r"portions of this software are copyright (?:\w+ ){0,6}?the freetype project", 1.0),
    ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e", 0.9),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", 0.9),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 1.0),
    ("beerware", "beer", r"the beer ?ware licen[cs]e", 1.0),
    ("json", "good not evil", r"the software shall be used for good not evil", 1.0),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to", 1.0),
    ("blessing", "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", 1.0),
    # public domain and waivers
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense org", r"(?:refer to http )?unlicense org", 0.9),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated|put|is) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "public domain", r"public domain dedication", 0.7),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related or neighboring rights", 1.0),
    ("cc0-1.0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("pddl-1", "public domain dedication", r"public domain dedication and licen[cs]e", 1.0),
    # content, data, fonts
    ("cc-by", "creative commons", r"licensed under a creative commons attribution", 0.8),
    ("cc-by-sa", "creative commons", r"licensed under a creative commons attribution share ?alike", 0.9),
    ("cc-by-nc", "creative commons", r"licensed under a creative commons attribution non ?commercial", 0.9),
    ("odbl-1", "open database", r"made available under the open database licen[cs]e", 1.0),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?", 1.0),
    ("odc-by-1", "open data commons attribution", r"open data commons attribution licen[cs]e(?: v?1 0)?", 1.0),
    ("ogl-uk", "open government", r"(?:contains public sector information )?licensed under the open government licen[cs]e(?: v\d 0)?", 1.0),
    ("cdla-permissive", "community data license", r"community data license agreement permissive", 1.0),
    ("cdla-sharing", "community data license", r"community data license agreement sharing", 1.0),
    ("ofl-1.1", "open font", r"this font software is licensed under the sil open font licen[cs]e version 1 1", 1.0),
    ("ofl", "reserved font name", r"with reserved font name", 0.8),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream", 1.0),
    ("free-art", " art", r"(?:free art licen[cs]e|licence art libre)(?: 1 \d)?", 0.9),
    # source available and models
    ("busl-1.1", "business source", r"business source licen[cs]e(?: 1 1)?", 1.0),
    ("sspl-1", "server side public", r"server side public licen[cs]e(?: version 1)?", 1.0),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: 2 0)?", 0.9),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)? condition", 1.0),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial) licen[cs]e", 1.0),
    ("openrail", "rail", r"(?:bigscience |creativeml )?open ?rail(?: m| \w+)?(?: licen[cs]e)?", 0.9),
    ("llama", "community license agreement", r"llama \d(?: \d)? community license agreement", 1.0),
    # notices of no license
    ("warranty-disclaimer", "without warranty", r"provided as is without warranty of any kind", 0.5),
    ("proprietary", "all rights reserved", r"copyright (?:c )?(?:\d{4} )?(?:\w+ ){0,6}?all rights reserved", 0.5),
    ("proprietary", "confidential", r"confidential and proprietary", 0.5),
    ("proprietary", "trade secret", r"(?:contains|constitutes) (?:confidential information and )?(?:valuable )?trade secrets? of", 0.5),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 0.8),
    ("proprietary", "may not be", r"may not be (?:reproduced|copied|distributed)(?: \w+){0,12} without the (?:express|prior) (?:written )?(?:permission|consent)", 0.6),
    ("proprietary", "end user licen", r"end user licen[cs]e agreement", 0.6),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes) only", 0.5),
    ("research-only", "research purposes", r"for (?:academic |non ?commercial )?research purposes only", 0.5),
)

_V = r"(?:version |v |ver |v)?"


def _version(v: str) -> str:
    return v + (r"(?: 0)?(?! ?\d)" if " " not in v else r"(?! ?\d)")


def build_rules() -> tuple[Rule, ...]:
    """Hundreds of rules: the sentences, and the names of families and versions in their usual spellings, most specific first."""
    rules = [Rule(label, 0, key, p, s) for label, key, p, s in SENTENCES]
    for stem, names, shorts, versions in VERSIONED:
        for name in names:
            key = name.replace("[cs]e", "").strip()
            for v in versions:
                label = f"{stem}-{v.replace(' ', '.')}"
                rules.append(Rule(label + "-or-later", 1, key, rf"{name} {_V}{_version(v)} or (?:any )?later", 1.0))
                rules.append(Rule(label, 2, key, rf"{name} {_V}{_version(v)}", 1.0))
            rules.append(Rule(stem, 5, key, name, 0.8))
        for short in shorts:
            for v in versions:
                label = f"{stem}-{v.replace(' ', '.')}"
                rules.append(Rule(label + "-only", 1, short, rf"spdx license identifier {short} {v}(?: 0)? only", 1.0))
                rules.append(Rule(label + "-or-later", 1, short, rf"spdx license identifier {short} {v}(?: 0)? or later", 1.0))
                rules.append(Rule(label, 3, short, rf"{short} ?{_V}{_version(v)}", 0.9))
    for n in ("0", "1", "2", "3", "4"):
        rules.append(Rule(f"bsd-{n}-clause", 2, "bsd", rf"(?:{n} clause bsd|bsd {n} clause)(?: licen[cs]e)?", 1.0))
    for word, n in (("two", 2), ("three", 3), ("four", 4)):
        rules.append(Rule(f"bsd-{n}-clause", 2, "bsd", rf"{word} clause bsd(?: licen[cs]e)?", 1.0))
    rules.append(Rule("bsd", 5, "bsd", r"bsd(?: style)? licen[cs]e", 0.8))
    terms = (("", ""), ("-sa", " sharealike"), ("-nc", " noncommercial"), ("-nd", " noderivs"), ("-nc-sa", " noncommercial sharealike"), ("-nc-nd", " noncommercial noderivs"))
    for tag, words in terms:
        long = "creative commons attribution" + words.replace("sharealike", "share ?alike").replace("noncommercial", "non ?commercial").replace("noderivs", r"no ?deriv\w*")
        short = "cc by" + tag.replace("-", " ")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-by{tag}-{v.replace(' ', '.')}"
            rules.append(Rule(label, 1, "creative commons", rf"{long} (?:international )?(?:licen[cs]e )?(?:version )?{v}", 1.0))
            rules.append(Rule(label, 1, "cc by", rf"{short} {v}", 1.0))
            rules.append(Rule(label, 1, "creativecommons", rf"creativecommons org licenses by{tag.replace('-', ' ')} {v}", 1.0))
        rules.append(Rule(f"cc-by{tag}", 4 - tag.count("-"), "creative commons", long, 0.9))
        rules.append(Rule(f"cc-by{tag}", 4 - tag.count("-"), "cc by", short, 0.7))
    rules.append(Rule("cc0-1.0", 1, "cc0", r"cc0(?: 1 0)?(?: universal)?", 1.0))
    rules.append(Rule("spdx", 8, "spdx license identifier", r"spdx license identifier \w+", 0.6))
    return tuple(rules)


@lru_cache(maxsize=1)
def compiled() -> tuple[ahocorasick.Automaton, tuple[tuple[tuple[int, Rule, re.Pattern], ...], ...]]:
    """An automaton of all keywords, and the rules of each, with their place in the order; patterns end at a word's end."""
    by: dict[str, list] = {}
    for i, r in enumerate(sorted(build_rules(), key=lambda r: r.priority)):
        by.setdefault(r.keyword, []).append((i, r, re.compile(rf"{r.pattern}(?!\S)")))
    gate = ahocorasick.Automaton()
    for k, word in enumerate(by):
        gate.add_word(word, k)
    gate.make_automaton()
    return gate, tuple(tuple(v) for v in by.values())


def _matches(p: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Matches that begin where a word does. A pattern begins with letters, which are searched for as such; one within a word is passed over."""
    m = p.search(text)
    while m:
        start, end = m.span()
        if start == 0 or text[start - 1] == " ":
            yield start, end
            m = p.search(text, max(end, start + 1))
        else:
            m = p.search(text, start + 1)


def keep_outer(found: list[tuple[int, int]]) -> list[int]:
    """Of intervals [start, end) in order, the indices of those that no interval kept before contains.

    A tree over the starts holds the furthest end of the kept intervals that
    start up to each place: n log n, however many overlap.
    """
    starts = sorted({a for a, _ in found})
    place = {a: i + 1 for i, a in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    kept = []
    for i, (a, b) in enumerate(found):
        k, best = place[a], -1
        while k:
            best = max(best, furthest[k])
            k &= k - 1
        if best >= b:
            continue
        kept.append(i)
        k = place[a]
        while k < len(furthest) and furthest[k] < b:
            furthest[k] = b
            k += k & -k
    return kept


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the detections kept, in normalised text; overlaps are resolved by the rules' order."""
    gate, rules_of = compiled()
    found = []
    for k in {k for _, k in gate.iter(text)}:
        for i, r, p in rules_of[k]:
            found.extend((r.priority, a - b, a, i, b, r) for a, b in _matches(p, text))
    found.sort(key=lambda x: x[:4])
    return [(found[i][2], found[i][4], found[i][5]) for i in keep_outer([(x[2], x[4]) for x in found])]


_BASE = tuple((re.compile(rf"(?<!\S){p}(?!\S)"), label) for p, label in BASE)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float, list[tuple[str, int, int]]]:
    """Word count, base places, first and last base word, base labels, all labels, score, and detections in words."""
    words = text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []
    if not words:
        return 0, 0, None, None, [], [], 0.0, []
    t = b" ".join(words).decode("utf-8", "surrogatepass")
    kept = sorted(detections(t), key=lambda x: x[:2])
    places = [(m.start(), label) for p, label in _BASE for m in p.finditer(t)] if "license" in t else []
    base = {label for _, label in places}
    at, found = [], []
    if kept or places:
        # where each word starts, in characters: a place's word is the last that starts there or before
        starts = np.cumsum([0] + [len(w) + 1 for w in t.split(" ")[:-1]])
        at = (np.searchsorted(starts, [a for a, _ in places], side="right") - 1).tolist()
        ends = np.array([(a, b - 1) for a, b, _ in kept], np.int64).reshape(-1, 2)
        words_at = np.searchsorted(starts, ends, side="right") - 1
        found = [(r.label, a, b) for (_, _, r), (a, b) in zip(kept, words_at.tolist(), strict=True)]
    labels = base | {r.label for _, _, r in kept}
    score = max([r.score for _, _, r in kept] + [0.8] * bool(base), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(labels), score, found


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, detections."""
    d = narrow(docs, id_col, text_col)
    detection = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(detection)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for text in batch.column(1):
                got = scan(text.as_py())
                for c, v in zip(cols, (*got[:-1], [{"label": x, "first_word": a, "last_word": b} for x, a, b in got[-1]]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", *names])

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, detections array<struct<label:string,first_word:long,last_word:long>>"
    return map_arrow(d, run, schema)
