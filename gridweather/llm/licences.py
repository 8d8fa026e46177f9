"""Licence scan: canonical texts looked up by digest.

Texts are brought to one form (letters in lower case, copyright lines gone, equivalent spellings made equal, punctuation and
white space one blank), and their digests are joined by equality with those of known licences. Looked up are the entire text of
every document and every entire line of it, since short notices stand on a line of their own.

Null and empty texts have no licence. A line that occurs twice counts twice; repeated rows of one document are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweather.llm.common import doc_rows, once

# Public licence texts and the notices that their publishers recommend.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Copyright (c) 2020 Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
# The six kinds and the versions of one family, whose short notices and identifiers follow one rule.
FAMILY, VERSIONS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")
SHORT = ("Licensed under CC {kind} {version}.", "This work is licensed under CC {kind} {version}.", "CC {kind} {version}", "SPDX-License-Identifier: CC-{kind}-{version}")
KNOWN += tuple((f"CC-{kind}-{version}", text.format(kind=kind, version=version)) for kind in FAMILY for version in VERSIONS for text in SHORT)
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]|©|all rights reserved).*$"
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("per cent", "percent"), ("http:", "https:"), ("&", " and "))
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Known tables up to this many rows are sent to every task; larger ones meet the digests in a shuffled join.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """Canonical form with its line breaks kept."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.regexp_replace(out, PUNCTUATION, " ")


def whole(canonical_text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_text, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """licence, digest: one row per digest."""
    raw = spark.createDataFrame([(a, b) for a, b in known], "licence string, text string")
    return raw.select("licence", F.sha2(whole(canonical(F.col("text"))), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def licences(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, licence, whole_text (the document is this licence and nothing else), n_lines (lines that are a notice of it)."""
    table = known_digests(docs.sparkSession, known)
    if len(known) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    text = once(doc_rows(docs).where("text is not null"), "doc_id", c=canonical(F.col("text")))
    parts = F.concat(
        F.array(F.struct(F.lit(True).alias("whole_text"), whole(F.col("c")).alias("part"))),
        F.transform(F.split("c", "\n"), lambda line: F.struct(F.lit(False).alias("whole_text"), F.trim(line).alias("part"))),
    )
    rows = text.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*").where("part != ''")
    found = rows.select("doc_id", "whole_text", F.sha2("part", 256).alias("digest")).join(table, "digest")
    return found.groupBy("doc_id", "licence").agg(
        F.max("whole_text").alias("whole_text"), F.sum((~F.col("whole_text")).cast("bigint")).alias("n_lines")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(known=KNOWN) -> str:
    """DuckDB twin over ``documents``."""

    def canon(x: str) -> str:
        x = f"regexp_replace(lower({x}), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
        for spelling, one in SPELLINGS:
            x = f"replace({x}, {_quoted(spelling)}, {_quoted(one)})"
        return f"regexp_replace({x}, {_quoted(PUNCTUATION)}, ' ', 'g')"

    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known)
    squeeze = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    return f"""
with known as (
  select digest, min(licence) as licence from (
    select licence, sha256({squeeze.format(canon("text"))}) as digest from (values {rows}) v(licence, text)) group by digest),
docs as (select doc_id, {canon("text")} as c from documents where text is not null),
parts as (
  select doc_id, true as whole_text, {squeeze.format("c")} as part from docs
  union all
  select doc_id, false as whole_text, trim(line) as part from (select doc_id, unnest(string_split(c, chr(10))) as line from docs))
select doc_id, licence, bool_or(whole_text) as whole_text, cast(sum(case when whole_text then 0 else 1 end) as bigint) as n_lines
from parts join known on sha256(part) = digest where part <> '' group by doc_id, licence"""
