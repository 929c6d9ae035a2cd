"""License scans by sentence rules (DataFrame functions only).

A text is cut into sentences at blank lines and at sentence marks before white space (not in "v. 2.0"); a sentence is
normalised to its lower-case ASCII letters and digits with one blank between runs, its wrapped lines joined. A sentence
that equals a known licence sentence becomes that sentence's identifier; of any other, each line that is known by itself
does. The rest drops out, and the sequence of identifiers that is left is rewritten by ordered rules, each a run of
neighbouring identifiers that stands for a licence. A sentence is used up by the first rule that takes it, so longer and
stricter rules come first.

Whole texts are read. A null or empty text has no sentences, no licences and category "none". Repeated rows stay
repeated, and repeated licences of a text are listed once, in order of their names. Columns other than the two named
are not read. No shuffle: every row is judged on its own; the dictionary is a literal of about a hundred entries: grants, headers and
notices of common licences and SPDX tags, not whole licence texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence sentences, normalised as above, by identifier. {v} stands for a version.
_SENTENCES = {
    "mit-grant": "released under the mit license",
    "mit-ref": "licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "rights": "all rights reserved",
    "later": "or at your option any later version",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "apache-terms": "you may not use this file except in compliance with the license",
    "free-software": "this program is free software",
    "free-library": "this library is free software",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "boost": "distributed under the boost software license version 1 0",
    "wtfpl": "do what the fuck you want to public license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "spdx": "spdx license identifier",
}
#: Names that may follow an SPDX tag.
_SPDX_TAGS = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "BSL-1.0", "EPL-2.0", "Zlib", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
#: The notice of the GNU licences after its first clause, for one version and for later ones.
_GNU_NOTICE = "you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {v} of the license"
_GNU_NAMES = {"gpl": "general public license", "lgpl": "lesser general public license", "agpl": "affero general public license"}
_HEADERS = {"apache-the": "licensed under the apache license version 2 0 the license", "bsd-regents": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"}
_VERSIONED = {
    "apache": ("licensed under the apache license version {v}", ("1.0", "1.1", "2.0")),
    "gpl": ("this work is licensed under the gnu general public license version {v}", ("1", "2", "3")),
    "lgpl": ("this work is licensed under the gnu lesser general public license version {v}", ("2.1", "3")),
    "agpl": ("this work is licensed under the gnu affero general public license version {v}", ("3",)),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v {v}", ("1.1", "2.0")),
}
_CC_KINDS, _CC_VERSIONS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")
_SPDX_NAMES = {"apache": "Apache-{v}", "gpl": "GPL-{v}.0", "lgpl": "LGPL-{v}", "agpl": "AGPL-{v}.0", "mpl": "MPL-{v}"}
# End of fixed values.

Rule = tuple[tuple[str, ...], str]


def sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {text: name for name, text in _SENTENCES.items()}
    for name, (text, versions) in _VERSIONED.items():
        out |= {text.format(v=v.replace(".", " ")): f"{name}-{v}" for v in versions}
    for name, words in _GNU_NAMES.items():
        for v in _VERSIONED[name][1]:
            notice = _GNU_NOTICE.format(name=words, v=v.replace(".", " "))
            out |= {notice: f"{name}-{v}-terms", f"{notice} or at your option any later version": f"{name}-{v}-later"}
    out |= {text: name for name, text in _HEADERS.items()}
    out |= {tag.lower().replace("-", " ").replace(".", " "): f"tag-{tag.lower()}" for tag in _SPDX_TAGS}
    for kind in _CC_KINDS:
        out |= {f"licensed under cc {kind.lower().replace('-', ' ')} {v.replace('.', ' ')}": f"cc-{kind.lower()}-{v}" for v in _CC_VERSIONS}
    return out


def rules() -> list[Rule]:
    """(identifiers in a row, licence), first rule first."""
    out: list[Rule] = [
        (("rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"), (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
        (("rights", "bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"), (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
        (("mit-grant", "mit-permission", "mit-condition"), "MIT"), (("mit-permission", "mit-condition"), "MIT"),
    ]
    out += [(("spdx", f"tag-{tag.lower()}"), tag) for tag in _SPDX_TAGS]
    out += [(("bsd-grant", "bsd-source", "bsd-binary", "bsd-regents"), "BSD-3-Clause"), (("apache-the", "apache-terms"), "Apache-2.0"), (("apache-the",), "Apache-2.0")]
    for name in ("gpl", "lgpl", "agpl"):
        for v in _VERSIONED[name][1]:
            spdx = _SPDX_NAMES[name].format(v=v)
            for first in (("free-software",), ("free-library",), ()):
                out += [((*first, f"{name}-{v}-later"), spdx + "-or-later"), ((*first, f"{name}-{v}-terms", "later"), spdx + "-or-later"), ((*first, f"{name}-{v}-terms"), spdx)]
        out += [((f"{name}-{v}", "later"), _SPDX_NAMES[name].format(v=v) + "-or-later") for v in _VERSIONED[name][1]]
    out += [((f"{name}-{v}",), _SPDX_NAMES[name].format(v=v)) for name, (_, versions) in _VERSIONED.items() for v in versions]
    out += [((f"cc-{kind.lower()}-{v}",), f"CC-{kind}-{v}") for kind in _CC_KINDS for v in _CC_VERSIONS]
    return [*out, (("mit-grant",), "MIT"), (("mit-ref",), "MIT"), (("public-domain",), "Unlicense"), (("isc-permission",), "ISC"), (("boost",), "BSL-1.0"), (("wtfpl",), "WTFPL"), (("cc0",), "CC0-1.0"), (("rights",), "Proprietary")]


#: The first category, in this order, that one of a text's licences is in.
CATEGORIES = (("proprietary", r"^Proprietary$"), ("noncommercial", r"^CC-BY-NC"), ("copyleft", r"^(A|L)?GPL-|^MPL-|^CC-BY-SA"), ("no-derivatives", r"^CC-BY-ND"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A version mark that ends no sentence; where sentences are cut; what is neither letter, digit, cut nor line end.
VERSION, CUT, OTHER = r"(^|[^a-z0-9])v\.[ \t]+([0-9])", r"[.!?;:]+([ \t\n\r\f]|\z)|[\n\r][ \t\f]*[\n\r]+", r"[^a-z0-9\n\x0b]+"
#: What stands for a cut while line ends are kept.
MARK = "\x0b"


def text_sentences(text: Column) -> Column:
    """Normalised sentences, in text order, empty ones too; the lines of a sentence are kept apart by line feeds."""
    lower = F.regexp_replace(F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), _UPPER + "\r" + MARK, _LOWER + "\n "), VERSION, "$1v $2")
    return F.split(F.regexp_replace(F.regexp_replace(lower, CUT, MARK), OTHER, " "), MARK, -1)


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences, or else of the known lines of a sentence, in text order."""
    names = list(known)
    whole = lambda s: F.trim(F.regexp_replace(s, "[ \n]+", " "))
    of_lines = lambda s: F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.trim(x)), lambda x: x.isin(names))
    found = F.flatten(F.transform(text_sentences(text), lambda s: F.when(whole(s).isin(names), F.array(whole(s))).otherwise(of_lines(s))))
    name = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.transform(found, lambda s: name[s])


def match_rules(ids: Column, ordered: list[Rule]) -> Column:
    """Licences in sequence order, by rewriting |id||id| runs."""
    run = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    for pattern, licence in ordered:
        run = F.replace(run, F.lit(f"|{'||'.join(pattern)}|"), F.lit(f"|={licence}|"))
    return F.transform(F.filter(F.split(run, r"\|"), lambda x: F.startswith(x, F.lit("="))), lambda x: F.substring(x, F.lit(2), F.length(x)))


def _any_like(pattern: str) -> Column:
    return F.exists("licenses", lambda x: F.rlike(x, F.lit(pattern)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None, ordered: list[Rule] | None = None) -> DataFrame:
    """(id, n_sentences, sentence_ids, licenses, category): known sentences and licences as arrays."""
    found = docs.select(F.col(id_col), sentence_ids(F.col(text_col), known or sentences()).alias("sentence_ids"))
    found = found.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(match_rules(F.col("sentence_ids"), ordered or rules())))).otherwise(F.expr("cast(array() as array<string>)")))
    category = F.when(F.size("licenses") == 0, "none")
    for name, pattern in CATEGORIES:
        category = category.when(_any_like(pattern), name)
    return found.select(id_col, F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", "licenses", category.otherwise("permissive").alias("category"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same with comma-joined strings."""
    return found.select(id_col, "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "category")
