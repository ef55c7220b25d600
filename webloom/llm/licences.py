"""Licence scans with DataFrame functions alone: TF-IDF cosine to templates, inheritance by path joins.

A file's licence statements are its lines and its paragraphs that name a licence or a right. Each different
statement becomes a sparse vector of its words, weighted by term frequency and the inverse frequency over the
templates of statements, and takes the template of the largest cosine at THRESHOLD or more. A licence file is
also compared as a whole, with the templates of whole licences, from FILE_THRESHOLD on; a whole licence goes
before statements, so that what sets two licences with the same first sentence apart counts. A file has the
licence of its best statement. A file without one inherits from the nearest directory above it that has a
licence file: each different directory is joined with its ancestors once, so a directory of many files costs
one row there.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.session import checkpointed

THRESHOLD, FILE_THRESHOLD = 0.6, 0.8
#: What a licence statement holds, and the names of licence files.
TRIGGER = "(?i)licen[cs]e|copyright|all rights reserved|spdx|permission is hereby|permission to use|permission is granted|redistribution and use|public domain|creative commons|cc0"
#: Strings of which every trigger has one, in lower case.
TRIGGER_PARTS = ("licen", "copyright", "all rights reserved", "spdx", "permission ", "redistribution and use", "public domain", "creative commons", "cc0")
#: What stands between paragraphs: a line that is blank but for marks of comments.
BREAK = "\n[ \t\r\n/*#;%!-]*\n"
FILE_NAME = "(?i)^(licen[cs]e|copying|copyright|unlicense|notice)([-_.].*)?$"
#: Short public forms of licence statements.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("ISC", "Licensed under the ISC License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("Artistic-1.0", 'The "Artistic License" Preamble'),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: Whole public licences that are short enough to be quoted whole.
FILES = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD[0] + _BSD[2]),
    ("BSD-3-Clause", "".join(_BSD)),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
)


def weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template number, licence, term, unit weight) rows; the inverse frequency of each term; that of others."""
    bags = [Counter(re.findall("[a-z0-9]+", t.lower())) for _, t in templates]
    held = Counter(w for b in bags for w in b)
    other = math.log(1 + len(templates)) + 1
    idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in held.items()}
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        rows += [(k, name, w, n * idf[w] / norm) for w, n in sorted(bag.items())]
    return rows, idf, other


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _constant(df: DataFrame, rows: list[dict], kind: str) -> DataFrame:
    """A table of constants, as one JSON literal."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def classify(statements: DataFrame) -> DataFrame:
    """(whole, id, licence, cosine) for each different statement(whole, id, statement) that reaches its threshold.

    whole 0 is compared with TEMPLATES, whole 1 with FILES. Of templates at the same cosine, to nine places,
    the first listed counts. Null statements are left out. Statements are dealt once, by their id, and all
    that follows stays where they are.
    """
    words, vectors, other = [], [], F.lit(None).cast("double")
    for whole, templates in enumerate((TEMPLATES, FILES)):
        rows, idf, rest = weights(templates)
        words += [{"whole": whole, "term": t, "idf": v} for t, v in idf.items()]
        vectors += [{"whole": whole, "template": k, "licence": name, "term": t, "weight": v} for k, name, t, v in rows]
        other = F.when(F.col("whole") == whole, rest).otherwise(other)
    # both tables are constants of this module, under two thousand rows
    inverse = F.broadcast(_constant(statements, words, "whole:int,term:string,idf:double"))
    of = F.broadcast(_constant(statements, vectors, "whole:int,template:int,licence:string,term:string,weight:double"))
    different = statements.filter("statement is not null").dropDuplicates(["whole", "id"])
    terms = different.select("whole", "id", F.explode(_words(F.col("statement"))).alias("term")).groupBy("whole", "id", "term").agg(F.count("*").alias("n"))
    terms = terms.join(inverse, ["whole", "term"], "left").withColumn("w", F.col("n") * F.coalesce("idf", other))
    terms = terms.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("whole", "id"))))
    dots = terms.join(of, ["whole", "term"]).groupBy("whole", "id", "norm", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= F.when(F.col("whole") == 0, THRESHOLD).otherwise(FILE_THRESHOLD))
    return near.groupBy("whole", "id").agg(F.max_by("licence", F.struct("cosine", -F.col("template"))).alias("licence"), F.max("cosine").alias("cosine"))


def triggered(text: Column) -> Column:
    """Whether a text has a trigger; most that have none are told by a search for plain strings."""
    low = F.lower(text)
    some = F.lit(False)
    for x in TRIGGER_PARTS:
        some |= low.contains(x)
    return some & text.rlike(TRIGGER)


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", is_licence_file: Column | None = None) -> DataFrame:
    """The licence of each row of files(key, path, text).

    Returns key, licence, cosine (of the best statement, else null), inherited, inherited_from (the licence
    and the directory of the nearest licence file above, for rows without a licence of their own), and
    is_licence_file: by its name, or as told. Of a licence file its whole text goes first, then of all
    statements the best cosine counts, of equal ones the licence first in the alphabet; of a directory's
    licence files likewise. Null and empty texts have no statement; a null path inherits nothing. Rows that
    repeat key, path and text repeat alike; an empty table gives an empty one; other columns play no part.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    rows = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"), (F.lit(False) if is_licence_file is None else F.coalesce(is_licence_file, F.lit(False))).alias("told"))
    rows = rows.withColumn("is_licence_file", F.coalesce(F.col("told") | name.rlike(FILE_NAME), F.lit(False)))
    kind = "array<struct<whole:int,id:string,statement:string>>"
    none = F.array().cast(kind)
    of = lambda whole, x: F.struct(F.lit(whole).alias("whole"), F.sha2(x, 256).alias("id"), x.alias("statement"))
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", BREAK)))
    stated = F.transform(F.array_distinct(F.filter(F.transform(parts, _tidy), lambda x: x.rlike(TRIGGER))), lambda x: of(0, x))
    whole = F.when(F.col("is_licence_file"), F.array(of(1, _tidy(F.col("text")))).cast(kind)).otherwise(none)
    statements = F.when(triggered(F.col("text")), F.concat(stated.cast(kind), whole)).otherwise(none)
    small = checkpointed(rows.select("key", "path", "is_licence_file", statements.alias("statements"), F.xxhash64("text").alias("version")))
    every = small.filter(F.size("statements") > 0).select("key", "path", "version", F.inline("statements"))
    known = checkpointed(classify(every))
    stated = every.select("key", "path", "version", "whole", "id").distinct()
    turned = F.translate("licence", "".join(chr(c) for c in range(32, 127)), "".join(chr(158 - c) for c in range(32, 127)))
    own = stated.join(known, ["whole", "id"]).groupBy("key", "path", "version").agg(F.max(F.struct("whole", "cosine", turned.alias("turned"), "licence")).alias("best"))
    o = own.select(F.col("key").alias("k"), F.col("path").alias("p"), F.col("version").alias("v"), "best.licence", "best.cosine", "best.whole")
    found = small.drop("statements").join(o, F.col("key").eqNullSafe(F.col("k")) & F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("v")), "left").drop("k", "p", "v", "version")
    found = checkpointed(found.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))))
    given = found.filter("is_licence_file and licence is not null and dir is not null").groupBy(F.col("dir").alias("above")).agg(F.max(F.struct("whole", "cosine", turned.alias("turned"), "licence"))["licence"].alias("inherited"))
    below = found.filter("licence is null and dir is not null").select("dir").distinct()
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/").alias("above")))
    ladder = below.select("dir", F.explode(steps).alias("s")).select("dir", "s.depth", "s.above")
    nearest = ladder.join(given, "above").groupBy("dir").agg(F.max_by("inherited", "depth").alias("inherited"), F.max_by("above", "depth").alias("inherited_from"))
    # a table of its own: the join below may then broadcast it, or split a directory of many files
    nearest = checkpointed(nearest.withColumnRenamed("dir", "d"))
    out = found.join(nearest, found["licence"].isNull() & (found["dir"] == nearest["d"]), "left")
    return out.select(F.col("key").alias(key), "licence", "cosine", "inherited", "inherited_from", "is_licence_file")


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def _values(templates: tuple[tuple[str, str], ...]) -> tuple[str, str, float]:
    """SQL rows of the vectors and of the inverse frequencies, and the inverse frequency of other words."""
    rows, idf, other = weights(templates)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quote(n)}, {quote(t)}, {w!r}::double)" for k, n, t, w in rows), ", ".join(f"({quote(t)}, {v!r}::double)" for t, v in sorted(idf.items())), other


def oracle() -> str:
    """DuckDB SQL for the query over `documents`, in which a text made mostly of licence statements is a licence file."""
    (v0, i0, o0), (v1, i1, o1) = _values(TEMPLATES), _values(FILES)
    trigger, plain = TRIGGER.removeprefix("(?i)"), "regexp_replace(lower(statement), '[^a-z0-9]+', ' ', 'g')"
    size = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"
    return f"""
with vectors(whole, template, licence, term, weight) as (select 0, * from (values {v0}) union all select 1, * from (values {v1})),
inverse(whole, term, idf) as (select 0, * from (values {i0}) union all select 1, * from (values {i1})),
files as (select doc_id, source || '/' || lang as dir, text, regexp_matches(text, '{trigger}', 'i') and {MOSTLY} * list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{trigger}', 'i')), lambda l: {size("l")})) >= {size("text")} as is_licence_file from documents),
lines as (select distinct * from (select doc_id, 0 as whole, trim(regexp_replace(l, '[ \t\r\n]+', ' ', 'g'), ' ') as statement from (select doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{BREAK.replace(chr(10), chr(92) + "n")}'))) as l from files where regexp_matches(text, '{trigger}', 'i')) where regexp_matches(l, '{trigger}', 'i')
 union all select doc_id, 1, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') from files where is_licence_file)),
terms as (select statement, whole, term, count(*) as n from (select statement, whole, unnest(string_split({plain}, ' ')) as term from (select distinct statement, whole from lines)) where term <> '' group by all),
weighed as (select t.statement, t.whole, t.term, t.n * coalesce(i.idf, case t.whole when 0 then {o0!r}::double else {o1!r}::double end) as w from terms t left join inverse i using (whole, term)),
norms as (select statement, whole, sqrt(sum(w * w)) as norm from weighed group by all),
dots as (select statement, whole, template, licence, sum(w * weight) as dot from weighed join vectors using (whole, term) group by all),
near as (select statement, whole, template, licence, round(dot / norm, 9) as cosine from dots join norms using (statement, whole)),
known as (select statement, whole, licence, cosine from near where cosine >= case whole when 0 then {THRESHOLD} else {FILE_THRESHOLD} end qualify row_number() over (partition by statement, whole order by cosine desc, template) = 1),
own as (select doc_id, whole, licence, cosine from lines join known using (statement, whole) qualify row_number() over (partition by doc_id order by whole desc, cosine desc, licence) = 1),
found as (select f.doc_id, f.dir, f.is_licence_file, o.whole, o.licence, o.cosine from files f left join own o using (doc_id)),
given as (select dir, licence as inherited from found where is_licence_file and licence is not null qualify row_number() over (partition by dir order by whole desc, cosine desc, licence) = 1),
ladder as (select doc_id, dir as above, 2 as depth from found where licence is null union all select doc_id, split_part(dir, '/', 1), 1 from found where licence is null),
nearest as (select l.doc_id, g.inherited, l.above as inherited_from from ladder l join given g on l.above = g.dir qualify row_number() over (partition by l.doc_id order by l.depth desc) = 1)
select f.doc_id, f.licence, round(f.cosine, 6) as cosine, n.inherited, n.inherited_from, f.is_licence_file from found f left join nearest n using (doc_id)
"""


#: A text of `documents` is its directory's licence file if this many times the words of its licence lines are all its words.
MOSTLY = 2


def of_documents(docs: DataFrame) -> DataFrame:
    """scan() over `documents`, a file source/lang/doc_id for each; a text made mostly of licence lines is a licence file."""
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    stated = F.aggregate(F.filter(F.split("text", "\n"), lambda x: x.rlike(TRIGGER)), F.lit(0), lambda n, x: n + words(x))
    mostly = F.when(triggered(F.col("text")), MOSTLY * stated >= words(F.col("text"))).otherwise(False)
    return scan(files, is_licence_file=mostly).withColumn("cosine", F.round("cosine", 6))
