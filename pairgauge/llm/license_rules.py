"""Ordered signature rules for licences.

Each licence lists hand-written regexes of its name, its address and of sentences only its text
holds. Names are tried in several forms (identifier line, grant, heading), so about sixty licences
give a few hundred rules. Every regex runs on text whose A-Z are lower-cased, and only where one of
its keywords occurs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: label, identifier in SPDX form, regex of the name, keyword of the name, other regexes with keywords.
LICENCES: tuple[tuple[str, str, str, str, tuple[tuple[str, str], ...]], ...] = (
    ("mit", r"mit", r"mit(?:/x11)? licen[cs]e", "mit", (
        (r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted, free"),
        (r"opensource\.org/licenses/mit", "licenses/mit"))),
    ("apache-2.0", r"apache-2\.0", r"apache (?:software )?licen[cs]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?", "apache", (
        (r"apache\.org/licenses/license-2\.0", "license-2.0"),
        (r"unless required by applicable law or agreed to in writing, software", "agreed to in writing"))),
    ("apache-1.1", r"apache-1\.1", r"apache (?:software )?licen[cs]e,?\s*(?:version|v\.?)?\s*1\.1", "apache", ()),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?<!lesser )(?<!affero )gnu? ?general public licen[cs]e,?\s*(?:\(gpl\)\s*)?(?:version|v\.?)\s*2|gpl ?v2", "g", (
        (r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gpl-2.0"),)),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?<!lesser )(?<!affero )gnu? ?general public licen[cs]e,?\s*(?:\(gpl\)\s*)?(?:version|v\.?)\s*3|gpl ?v3", "g", (
        (r"gnu\.org/licenses/gpl-3\.0", "gpl-3.0"),)),
    ("gpl", r"gpl", r"gnu general public licen[cs]e", "general public", (
        (r"free software; you can redistribute it and/or modify\s+it under the terms of the gnu general", "and/or modify"),)),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu lesser general public licen[cs]e,?\s*(?:version|v\.?)\s*2\.1|lgpl ?v2\.1", "l", (
        (r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "lgpl-2.1"),)),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu lesser general public licen[cs]e,?\s*(?:version|v\.?)\s*3|lgpl ?v3", "l", (
        (r"gnu\.org/licenses/lgpl-3\.0", "lgpl-3.0"),)),
    ("lgpl", r"lgpl", r"gnu (?:lesser|library) general public licen[cs]e", "general public", ()),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu affero general public licen[cs]e|agpl ?v3", "a", (
        (r"gnu\.org/licenses/agpl-3\.0", "agpl-3.0"),)),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu free documentation licen[cs]e", "free documentation", ()),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified|2-clause|two-clause) bsd(?: licen[cs]e)?|bsd 2-clause", "bsd", ()),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new|modified|3-clause|three-clause) bsd(?: licen[cs]e)?|bsd 3-clause", "bsd", (
        (r"neither the name of .{1,80} nor the names of its contributors", "neither the name"),)),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original|4-clause|four-clause) bsd(?: licen[cs]e)?", "bsd", (
        (r"all advertising materials mentioning features or use of this software", "advertising materials"),)),
    ("bsd", r"0bsd", r"bsd licen[cs]e", "bsd", (
        (r"redistribution and use in source and binary forms", "redistribution and use"),)),
    ("isc", r"isc", r"isc licen[cs]e", "isc", (
        (r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "distribute this software"),)),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[cs]e,?\s*(?:version|v\.?)\s*1\.1", "mozilla", ()),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[cs]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?", "mozilla", (
        (r"mozilla\.org/mpl/2\.0", "mpl/2.0"),)),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[cs]e\s*(?:-|,)?\s*(?:version|v\.?)?\s*1\.0", "eclipse", ()),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[cs]e\s*(?:-|,)?\s*(?:version|v\.?)?\s*2\.0", "eclipse", (
        (r"eclipse\.org/legal/epl-2\.0", "epl-2.0"),)),
    ("eupl-1.2", r"eupl-1\.[12]", r"european union public licen[cs]e", "european union public", ()),
    ("cddl-1.0", r"cddl-1\.[01]", r"common development and distribution licen[cs]e", "common development", ()),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[cs]e", "common public", ()),
    ("artistic-2.0", r"artistic-(?:1\.0|2\.0)", r"artistic licen[cs]e", "artistic", ()),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", (
        (r"altered source versions must be plainly marked as such", "plainly marked"),)),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[cs]e", "boost", (
        (r"boost\.org/license_1_0", "license_1_0"),)),
    ("busl-1.1", r"busl-1\.1", r"business source licen[cs]e", "business source", ()),
    ("unlicense", r"unlicense", r"the unlicense", "unlicense", (
        (r"free and unencumbered software released into the public domain", "unencumbered"),)),
    ("wtfpl", r"wtfpl", r"do what the f\S{1,4} you want to public licen[cs]e|wtfpl", "w", ()),
    ("cc0-1.0", r"cc0-1\.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", "c", (
        (r"creativecommons\.org/publicdomain/zero", "publicdomain/zero"),)),
    ("cc-by-4.0", r"cc-by-4\.0", r"(?:cc[ -]by|creative commons attribution) 4\.0", "c", (
        (r"creativecommons\.org/licenses/by/4\.0", "licenses/by/"),)),
    ("cc-by-3.0", r"cc-by-3\.0", r"(?:cc[ -]by|creative commons attribution) 3\.0", "c", (
        (r"creativecommons\.org/licenses/by/3\.0", "licenses/by/"),)),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", r"(?:cc[ -]by-sa|creative commons attribution-sharealike) 4\.0", "c", (
        (r"creativecommons\.org/licenses/by-sa/4\.0", "by-sa/"),)),
    ("cc-by-sa-3.0", r"cc-by-sa-3\.0", r"(?:cc[ -]by-sa|creative commons attribution-sharealike) 3\.0", "c", (
        (r"creativecommons\.org/licenses/by-sa/3\.0", "by-sa/"),)),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", r"(?:cc[ -]by-nc|creative commons attribution-noncommercial) 4\.0", "c", (
        (r"creativecommons\.org/licenses/by-nc/4\.0", "by-nc/"),)),
    ("cc-by-nc-3.0", r"cc-by-nc-3\.0", r"(?:cc[ -]by-nc|creative commons attribution-noncommercial) 3\.0", "c", ()),
    ("cc-by-nc-sa-4.0", r"cc-by-nc-sa-4\.0", r"(?:cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike) 4\.0", "c", (
        (r"creativecommons\.org/licenses/by-nc-sa", "by-nc-sa"),)),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", r"(?:cc[ -]by-nd|creative commons attribution-noderivatives) 4\.0", "c", (
        (r"creativecommons\.org/licenses/by-nd", "by-nd/"),)),
    ("cc-by-nc-nd-4.0", r"cc-by-nc-nd-4\.0", r"(?:cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderivatives) 4\.0", "c", (
        (r"creativecommons\.org/licenses/by-nc-nd", "by-nc-nd"),)),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons open )?database licen[cs]e", "open d", (
        (r"opendatacommons\.org/licenses/odbl", "licenses/odbl"),)),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[cs]e", "open data commons", ()),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and licen[cs]e", "public domain dedication", ()),
    ("ofl-1.1", r"ofl-1\.1", r"sil open font licen[cs]e", "open font", (
        (r"scripts\.sil\.org/ofl", "sil.org/ofl"),)),
    ("postgresql", r"postgresql", r"postgresql licen[cs]e", "postgresql", ()),
    ("psf-2.0", r"psf-2\.0|python-2\.0", r"python software foundation licen[cs]e", "python software", ()),
    ("php-3.01", r"php-3\.01?", r"php licen[cs]e", "php", ()),
    ("ruby", r"ruby", r"ruby licen[cs]e", "ruby", ()),
    ("vim", r"vim", r"vim licen[cs]e", "vim", ()),
    ("openssl", r"openssl", r"openssl licen[cs]e", "openssl", ()),
    ("curl", r"curl", r"curl licen[cs]e", "curl", ()),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[cs]e", "server side public", ()),
    ("elastic-2.0", r"elastic-2\.0", r"elastic licen[cs]e", "elastic", ()),
    ("ncsa", r"ncsa", r"university of illinois/ncsa open source licen[cs]e", "ncsa", ()),
    ("afl-3.0", r"afl-3\.0", r"academic free licen[cs]e", "academic free", ()),
    ("osl-3.0", r"osl-3\.0", r"open software licen[cs]e", "open software", ()),
    ("ms-pl", r"ms-pl", r"microsoft public licen[cs]e", "microsoft public", ()),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal", ()),
    ("upl-1.0", r"upl-1\.0", r"universal permissive licen[cs]e", "universal permissive", ()),
    ("ecl-2.0", r"ecl-2\.0", r"educational community licen[cs]e", "educational community", ()),
    ("lppl-1.3c", r"lppl-1\.3[ac]?", r"latex project public licen[cs]e", "latex project", ()),
    ("beerware", r"beerware", r"beer-?ware licen[cs]e", "beer", ()),
    ("openrail-m", r"(?:big(?:science|code)-)?openrail-m", r"open(?: responsible ai licen[cs]e|rail-m)", "open", ()),
    ("proprietary", r"licenseref-\S+", r"all rights reserved\.? (?:unauthori[sz]ed|no part)", "all rights reserved", ()),
)

#: Form, priority, confidence, regex around the name, keyword ("" takes the name's own).
FORMS: tuple[tuple[str, int, float, str, str], ...] = (
    ("identifier", 90, 0.99, r"spdx-license-identifier:\s*(?:[\w.+-]+ (?:and|or|with) )*{spdx}(?![\w.+-])", "spdx-license"),
    ("grant", 70, 0.95, r"(?:licen[cs]ed|released|distributed|published|available|provided|covered) (?:to you )?(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{name})", "e"),
    ("field", 60, 0.9, r"(?:^|[\s\"'])licen[cs]e[\"']?\s*[:=]\s*[\"']?(?:{spdx})(?![\w.+-])", "licen"),
    ("name", 40, 0.8, r"(?<![\w-])(?:{name})(?![\w])", ""),
)
#: A short keyword says little; then the forms' own words gate the rule.
GATES = {"identifier": ("spdx-license",), "grant": ("licen", "gpl", "cc0", "wtfpl", "cc by", "cc-by", "creative commons", "bsd", "openrail"), "field": ("licen",)}
NAME_GATES = ("licen", "gpl", "cc0", "wtfpl", "cc by", "cc-by", "creative commons", "bsd", "openrail")


@dataclass(frozen=True)
class Rule:
    """One signature: higher priority wins where spans contain each other."""

    label: str
    form: str
    priority: int
    confidence: float
    regex: re.Pattern[str]
    keywords: tuple[str, ...]


def build() -> tuple[Rule, ...]:
    """All rules, highest priority first; equal ones in the order of ``LICENCES``."""
    rules = []
    for label, spdx, name, word, others in LICENCES:
        for form, priority, confidence, around, _ in FORMS:
            text = around.replace("{spdx}", f"(?:{spdx})").replace("{name}", name)
            keys = GATES.get(form) or ((word,) if len(word) > 3 else NAME_GATES)
            rules.append(Rule(label, form, priority, confidence, re.compile(text), keys))
        for text, key in others:
            rules.append(Rule(label, "text", 80, 0.97, re.compile(text), (key,)))
    return tuple(sorted(rules, key=lambda r: -r.priority))
