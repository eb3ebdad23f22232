"""Licence scans by sentence rules, in DataFrame expressions alone.

A text is cut into sentences (and unknown ones into their lines), each is normalised,
known ones become identifiers, and the sequence of a text's identifiers is matched against
rules: a licence is found where its sentences follow in order, whatever stands between them.
Some known sentences have a gap for a holder's name.  The tables of sentences and rules are parameters; ``KNOWN`` and ``RULES`` hold common public
ones, and the short tags of ``SPDX`` by rule.  A known sentence is one piece of the scan's
own cutting, so what official wording spreads over several pieces is several known
sentences in a row.  Sentences are looked up in a hash set; only the known ones, a few of a
text, meet the table of identifiers.

Rules are judged each by itself, but a licence whose text is part of another one's
(``PART_OF``) is named only where the larger one is not.

One narrow pass without a shuffle; texts in which no known sentence can stand, because
they lack every hint, skip the cutting.  Null and empty texts have no sentences and no
licence; repeated rows are judged alike; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licences.
KNOWN = {
    "mit-name": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-condition": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "apache-copy-at": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "gpl3-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-name": "licensed under cc by 4 0",
    "cc-by-sa-name": "licensed under cc by sa 4 0",
    "cc-by-nc-name": "licensed under cc by nc 4 0",
    "cc0-dedication": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "gpl21-later": "either version 2 1 of the license or at your option any later version",
    "gpl3-later": "either version 3 of the license or at your option any later version",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "library-free": "this library is free software",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "perl-terms": "you can redistribute it and or modify it under the same terms as perl itself",
    "epl1-header": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2-header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "mpl11-header": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "boost-name": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "wtfpl-copying": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc-by-full": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-full": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-full": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-sa-full": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nd-full": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-nd-full": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "cc-by-3-full": "this work is licensed under a creative commons attribution 3 0 unported license",
    "cc-by-sa-3-full": "this work is licensed under a creative commons attribution sharealike 3 0 unported license",
    "mit-under": "licensed under the mit license",
    "bsd-endorse-tail": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl2-version-of": "you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation",
    "gpl2-software": "this software is licensed under the terms of the gnu general public license version 2 as published by the free software foundation and may be copied distributed and modified under those terms",
    "gpl2-may": "you may redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-exact": "version 2 of the license",
    "gpl2-only-exact": "only version 2 of the license",
    "gpl21-exact": "version 2 1 of the license",
    "lgpl2-library-terms": "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation",
    "gpl2-head": "gnu general public license version 2 june 1991",
    "gpl3-head": "gnu general public license version 3 29 june 2007",
    "lgpl21-head": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-head": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-head": "gnu affero general public license version 3 19 november 2007",
    "apache-head": "apache license version 2 0 january 2004",
    "apache-head-url": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-head-urls": "apache license version 2 0 january 2004 https www apache org licenses",
}

# Sentences with a gap for a name, as their beginning and end; the first that fits counts.
GAPS = {
    "bsd-endorse": ("neither the name of ", " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-endorse-begins": ("neither the name of ", ""),
}

# Licences as ordered sentence identifiers.
RULES = {
    "MIT": (("mit-name",), ("mit-under",), ("mit-grant", "mit-notice", "as-is")),
    "Apache-2.0": (("apache-name",), ("apache-header", "apache-condition"), ("apache-condition", "apache-copy"), ("apache-condition", "apache-copy-at", "apache-url"), ("apache-head",), ("apache-head-url",), ("apache-head-urls",)),
    "GPL-3.0-only": (("gpl3-name",), ("gpl3-head",)),
    "GPL-3.0-or-later": (("gpl3-or-later", "gpl-warranty", "gpl-copy"), ("gpl3-or-later", "gpl-warranty"), ("gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied"), ("gpl-free", "gpl-terms", "gpl3-later")),
    "BSD-4-Clause": (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"),),
    "BSD-3-Clause": (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-tail"), ("bsd-grant", "bsd-source", "bsd-binary", "bsd-author")),
    "BSD-2-Clause": (("bsd-grant", "bsd-source", "bsd-binary"),),
    "ISC": (("isc-grant",), ("isc-grant-and",)),
    "MPL-2.0": (("mpl2-header",),),
    "CC-BY-4.0": (("cc-by-name",), ("cc-by-full",)),
    "CC-BY-SA-4.0": (("cc-by-sa-name",), ("cc-by-sa-full",)),
    "CC-BY-NC-4.0": (("cc-by-nc-name",), ("cc-by-nc-full",)),
    "CC-BY-NC-SA-4.0": (("cc-by-nc-sa-full",),),
    "CC-BY-ND-4.0": (("cc-by-nd-full",),),
    "CC-BY-NC-ND-4.0": (("cc-by-nc-nd-full",),),
    "CC-BY-3.0": (("cc-by-3-full",),),
    "CC-BY-SA-3.0": (("cc-by-sa-3-full",),),
    "CC0-1.0": (("cc0-dedication",),),
    "GPL-2.0-only": (("gpl-free", "gpl2-terms"), ("gpl-free", "gpl2-version-of"), ("gpl-free", "gpl2-may"), ("gpl2-software",), ("gpl-free", "gpl-terms", "gpl2-exact"), ("gpl-free", "gpl-terms", "gpl2-only-exact"), ("gpl2-head",)),
    "GPL-2.0-or-later": (("gpl-free", "gpl-terms", "gpl2-later"),),
    "LGPL-2.0-or-later": (("lgpl2-library-terms", "gpl2-later"),),
    "LGPL-2.1-only": (("lgpl-terms", "gpl21-exact"), ("lgpl21-head",)),
    "LGPL-2.1-or-later": (("lgpl-terms", "gpl21-later"),),
    "LGPL-3.0-only": (("lgpl3-head",),),
    "AGPL-3.0-only": (("agpl3-head",),),
    "LGPL-3.0-or-later": (("lgpl3-terms",), ("lgpl-terms", "gpl3-later")),
    "AGPL-3.0-or-later": (("gpl-free", "agpl3-terms"),),
    "Artistic-1.0-Perl": (("perl-terms",),),
    "EPL-1.0": (("epl1-header",),),
    "EPL-2.0": (("epl2-header",),),
    "MPL-1.1": (("mpl11-header",),),
    "Unlicense": (("unlicense-domain",),),
    "BSL-1.0": (("boost-name",), ("boost-grant",)),
    "Zlib": (("zlib-as-is", "zlib-grant"),),
    "0BSD": (("0bsd-grant",),),
    "MIT-0": (("mit0-grant", "as-is"),),
    "PostgreSQL": (("postgresql-grant",),),
    "WTFPL": (("wtfpl-copying",),),
}

# Licences that short tags name, besides those of the rules.
SPDX = ("AFL-3.0", "Artistic-2.0", "BSD-3-Clause-Clear", "BUSL-1.1", "CC-BY-NC-SA-3.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "GFDL-1.3-or-later", "GPL-1.0-or-later", "HPND", "ICU", "IJG", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PHP-3.01", "Python-2.0", "PSF-2.0", "Ruby", "SSPL-1.0", "UPL-1.0", "Vim", "W3C", "X11", "ZPL-2.1")


def _tagged(known: dict[str, str], rules: dict[str, tuple]) -> tuple[dict[str, str], dict[str, tuple]]:
    """The tables with the tag of every licence as one more sentence and one more way to find it."""
    names = [*rules, *SPDX]
    tag = {name: "spdx-" + name.lower().replace(".", "-") for name in names}
    said = {tag[n]: "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", n.lower())) for n in names}
    return known | said, {n: (*rules.get(n, ()), (tag[n],)) for n in names}


KNOWN, RULES = _tagged(KNOWN, RULES)

# Names of old tags that are now said with "only".
OLD_TAGS = ("gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "gfdl-1.3")

#: Not named where one of these sentences stands: the text goes on to say more than the rule.
UNLESS = {"BSD-2-Clause": ("bsd-endorse-begins", "bsd-endorse-tail", "bsd-author")}

#: Named only where none of these is.
PART_OF = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",)}

#: Every known sentence holds one of these, whatever the case.
HINTS = ("licen", "copyright", "warrant", "permi", "redistribut", "free software", "public domain", "advertising materials")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# "v. 2.0" holds no end of a sentence, but may be one
_STOP = r"(\bv[.][\x20\x09-\x0D#*/]+[0-9][0-9.]*|[.!?;:][\x20\x09-\x0D])[\x20\x09-\x0D]*"
_GAP = r"\n[\x20\x09-\x0D#*/;%!<>-]*\n"
_OTHER = "[^a-z0-9]+"
#: No end of a sentence.
_TAG, _UNCUT = "spdx-license-identifier:", "spdx-license-identifier"


def sentences(text: Column) -> Column:
    """Sentences in lower case: cut behind . ! ? ; : and at lines that are blank or hold comment marks alone."""
    lower = F.replace(F.translate(text, _UPPER, _LOWER), F.lit(_TAG), F.lit(_UNCUT))
    return F.split(F.regexp_replace(lower, _STOP, "$1\n\n"), _GAP)


def normalised(sentence: Column) -> Column:
    """Letters and digits alone."""
    return F.trim(F.regexp_replace(sentence, _OTHER, " "))


#: A name in the expression behind a tag.
_NAME = r"[a-z0-9]+(?:[.-][a-z0-9]+)*[+]?"


def _openings(known: dict[str, str], gaps: dict[str, tuple[str, str]]) -> list[str]:
    """The first two words of all known sentences: where a line begins with them, one may begin."""
    return sorted({" ".join(s.split()[:2]) for s in [*known.values(), *(begin for begin, _ in gaps.values())]})


def identifiers(text: Column, known: dict[str, str], gaps: dict[str, tuple[str, str]]) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence that is unknown as a whole is looked at from its lines: each by itself, and
    from each that opens like a known sentence to the end, for what stands before a licence
    need not end in a full stop.  The first such rest that is known ends the search.  Lines
    with a tag give all licences that the expression behind it names.
    """
    table = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in known.items()))

    def named(s: Column) -> Column:
        found = F.when(s.isin(*known.values()), F.try_element_at(table, s))  # a hash set once there are a few
        for name, (begin, end) in gaps.items():
            found = found.when(s.startswith(begin) & s.endswith(end), name)
        return found

    def tags(line: Column) -> Column:
        names = F.regexp_extract_all(F.substring_index(line, _UNCUT, -1), F.lit(_NAME), F.lit(0))
        modern = F.transform(names, lambda t: F.when(t.isin(*OLD_TAGS), F.concat(t, F.lit("-only"))).otherwise(F.regexp_replace(t, "[+]$", "-or-later")))
        return F.transform(modern, lambda t: named(F.concat(F.lit("spdx license identifier "), normalised(t))))

    def by_lines(raw: Column) -> Column:
        lines = F.transform(F.split(raw, "\n"), lambda line: F.struct(line.alias("raw"), normalised(line).alias("plain")))
        rest = lambda i: named(normalised(F.array_join(F.slice(F.transform(lines, lambda x: x["raw"]), i + 1, F.size(lines)), " ")))
        opens = lambda x, i: (i > 0) & (i + 1 < F.size(lines)) & F.substring_index(x["plain"], " ", 2).isin(*_openings(known, gaps))
        rests = F.transform(lines, lambda x, i: F.when(opens(x, i), F.struct(i.alias("at"), rest(i).alias("id"))))
        first = F.get(F.filter(rests, lambda r: r["id"].isNotNull()), F.lit(0))
        before = F.slice(lines, 1, F.coalesce(first["at"], F.size(lines)))
        own = F.flatten(F.transform(before, lambda x: F.when(F.contains(x["raw"], F.lit(_UNCUT)), tags(x["raw"])).otherwise(F.array(named(x["plain"])))))
        return F.concat(own, F.array(first["id"]))

    each = F.transform(sentences(text), lambda s: F.struct(s.alias("raw"), named(normalised(s)).alias("id")))
    found = F.flatten(F.transform(each, lambda s: F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(by_lines(s["raw"]))))
    return F.when(F.lower(text).rlike("|".join(HINTS)), F.filter(found, lambda i: i.isNotNull())).otherwise(F.array().cast("array<string>"))


def _in_order(sequence: tuple[str, ...]) -> str:
    """Pattern of a sequence of identifiers in ``,a,b,c,``, others between them or not."""
    return "," + ",(.*,)?".join(sequence) + ","


def _judged(rules: dict[str, tuple], part_of: dict[str, tuple], unless: dict[str, tuple]) -> dict[str, tuple[list[str], list[str]]]:
    """By licence the patterns of which one must be found, and those of which none may be."""
    some = {name: [_in_order(v) for v in variants] for name, variants in rules.items()}
    return {name: (some[name], [p for larger in part_of.get(name, ()) if larger in some for p in some[larger]] + [_in_order((i,)) for i in unless.get(name, ())]) for name in rules}


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, rules: dict[str, tuple] = RULES, part_of: dict[str, tuple] = PART_OF, gaps: dict[str, tuple[str, str]] = GAPS, unless: dict[str, tuple] = UNLESS) -> DataFrame:
    """doc_id, n_known, sentence_ids, licences (both joined by commas): one row per row of ``docs``."""
    if lost := [s for s in [*known.values(), *(begin + end for begin, end in gaps.values() if end)] if not any(h in s for h in HINTS)]:
        raise ValueError(f"no hint in {lost}")
    ids = docs.select(F.col("doc_id").cast("long"), identifiers(F.col("text").cast("string"), known, gaps).alias("ids"))
    joined = ids.select("doc_id", F.size(F.coalesce("ids", F.array().cast("array<string>"))).alias("n_known"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"))
    chain_ = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    any_ = lambda patterns: functools.reduce(Column.__or__, map(chain_.rlike, patterns), F.lit(False))
    named = [F.when(any_(some) & ~any_(none), F.lit(name)) for name, (some, none) in _judged(rules, part_of, unless).items()]
    return joined.withColumn("licences", F.when(F.col("n_known") > 0, F.concat_ws(",", *named)).otherwise(""))


def duckdb_sql(known: dict[str, str] = KNOWN, rules: dict[str, tuple] = RULES, part_of: dict[str, tuple] = PART_OF, gaps: dict[str, tuple[str, str]] = GAPS, unless: dict[str, tuple] = UNLESS) -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    table = ", ".join(f"'{s}': '{i}'" for i, s in known.items())
    plain = lambda x: f"trim(regexp_replace({x}, '{_OTHER}', ' ', 'g'))"
    in_gap = lambda x: " ".join(f"WHEN starts_with({x}, '{begin}') AND ends_with({x}, '{end}') THEN '{name}'" for name, (begin, end) in gaps.items())
    named = lambda x: f"coalesce(m[{x}], CASE {in_gap(x)} END)"
    openings = ", ".join(f"'{o}'" for o in _openings(known, gaps))
    old = ", ".join(f"'{t}'" for t in OLD_TAGS)
    modern = f"CASE WHEN t IN ({old}) THEN t || '-only' ELSE regexp_replace(t, '[+]$', '-or-later') END"
    tags = f"list_transform(regexp_extract_all(string_split(l[i], '{_UNCUT}')[-1], '{_NAME}'), lambda t: {named(f"'spdx license identifier ' || {plain(modern)}")})"
    some = lambda patterns: "(" + (" OR ".join(f"regexp_matches(c, '{p}')" for p in patterns) or "false") + ")"
    hits = ", ".join(f"CASE WHEN {some(a)} AND NOT {some(b)} THEN '{name}' END" for name, (a, b) in _judged(rules, part_of, unless).items())
    return f"""
WITH parted AS (SELECT row_number() OVER () r, doc_id, string_split_regex(regexp_replace(replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TAG}', '{_UNCUT}'), '{_STOP}', E'\\\\1\\n\\n', 'g'), '{_GAP}') s FROM documents),
     known AS (SELECT MAP {{{table}}} m),
     raws AS (SELECT r, generate_subscripts(s, 1) pos, unnest(s) raw FROM parted),
     whole AS (SELECT r, pos, raw, string_split(raw, E'\\n') l, {named(plain("raw"))} id, m FROM raws, known),
     lined AS (SELECT *, list_transform(l, lambda y: {plain("y")}) p FROM whole),
     rested AS (SELECT *, CASE WHEN id IS NULL THEN list_transform(range(2, len(l)), lambda i: CASE WHEN array_to_string(string_split(p[i], ' ')[1:2], ' ') IN ({openings}) THEN {named(plain("array_to_string(l[i:], ' ')"))} END) END rests FROM lined),
     placed AS (SELECT *, list_position(list_transform(rests, lambda x: x IS NOT NULL), true) + 1 stop FROM rested),
     own AS (SELECT r, pos, CASE WHEN id IS NOT NULL THEN [id] ELSE list_append(flatten(list_transform(range(1, CASE WHEN stop > 1 THEN stop ELSE len(l) + 1 END), lambda i: CASE WHEN contains(l[i], '{_UNCUT}') THEN {tags} ELSE [{named("p[i]")}] END)), CASE WHEN stop > 1 THEN rests[stop - 1] END) END ids FROM placed),
     together AS (SELECT r, list_filter(flatten(list(ids ORDER BY pos)), lambda i: i IS NOT NULL) ids FROM own GROUP BY r),
     joined AS (SELECT doc_id, CAST(len(ids) AS INTEGER) n_known, array_to_string(ids, ',') sentence_ids, ',' || array_to_string(ids, ',') || ',' c FROM parted JOIN together USING (r))
SELECT doc_id, n_known, sentence_ids, CASE WHEN n_known > 0 THEN concat_ws(',', {hits}) ELSE '' END licences FROM joined
"""
