"""License scans: canonical digest lookup of entire texts.

A text is normalised (case, punctuation, copyright statements, equivalent spellings, white space), its canonical form hashed, and the digest
joined to the digests of known licence texts. Only whole texts match: a page that merely quotes a licence has another digest.
Known are the texts below and those in the folder licenses, each with and without its title or appendix, line breaks and list numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, lean, named

# fixed values: spellings that licence matching guidelines treat as the same word
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "sub licence": "sublicense", "analogue": "analog", "authorisation": "authorization",
    "authorised": "authorized", "behaviour": "behavior", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "favourable": "favorable",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "merchantability": "merchantability", "modelling": "modeling",
    "noncommercial": "non commercial", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "per cent": "percent", "copyright owner": "copyright holder", "https": "http", "gnu gpl": "gnu general public license",
    "version 2 0": "version 2", "version 3 0": "version 3", "v2 0": "version 2", "v3": "version 3",
}

# a copyright statement is a mark, years and at most 20 words of a holder's name (capitals, connectors, addresses), up to the last of them before: all rights
# reserved, the opening of a licence, a full stop or the end of the line; a mark without such an end goes alone
_YEARS = r"(?:(?:(?:19|20)\d\d|present)(?:[\s,–-]*(?:(?:19|20)\d\d|present))*|[\[<{](?:year|yyyy)s?[\]>}]|yyyy)\b"
_MARK = rf"""(?:
    (?:portions\s+)?copyright\b[\s:]*(?:(?:\(c\)|©)(?:[\s:,]*(?:copyright\b[\s:,]*)?{_YEARS})?|{_YEARS})
  | (?:\(c\)|©)[\s:,]*(?:copyright\b[\s:,]*)?{_YEARS}
  | ^[^\w\n©]*+(?:©|portions\s+copyright\b|copyright\s+(?=[0-9]))
)"""
_OPENING = r"(?:permission\s+(?:is|to)\b|redistributions?\s+(?:and|of|in)\b|(?:licen[sc]ed|released|distributed)\s+under\b|this\s+(?:\w+\s+)?(?:is|may|software|program|library|work|file)\b|everyone\s+is\b|the\s+above\b)"
_RIGHTS = r"all\s+rights\s+reserved\b\.?"
_NAME = rf"(?!{_OPENING}|{_RIGHTS})(?:(?:and|of|the|for|by|de|von|van|its|et|al|other|others|authors?|contributors?|holders?|present)\b|<[^<>\n]{{1,80}}>|\[[^\[\]\n]{{1,80}}\]|\([^()\n]{{1,80}}\)|https?://[^\s<>]+|[\w.+-]+@[\w.-]+\w|&|(?-i:[A-Z0-9À-￿])[\w&'’/-]*(?:\.\w+)*)"
_COPYRIGHT = re.compile(
    rf"{_MARK}(?:[:,]?(?:(?>[ \t,]*{_NAME})(?!\w)(?>[.,;]*)){{0,20}}(?:[ \t.,;]{{0,4}}{_RIGHTS}|(?<=[.])(?=\s)|[ \t]{{0,4}}(?=\b{_OPENING})|[ \t]{{0,4}}$)|[:,;]?(?:[ \t]{{1,4}}(?>\S{{1,60}})(?!\S)(?<!\.)){{1,5}}[ \t]{{0,4}}$)?"
    r"|^[^\w\n]*+all\ rights\ reserved\b\.?|^[^\w\n(]*+\(c\)[ \t]+(?-i:[A-Z][\w.&'-]*)(?:[ ,]+(?-i:[A-Z][\w.&'-]*)){0,5}[ \t]*$",
    re.I | re.M | re.X,
)
_CONTRIBUTORS = re.compile(r"\bneither the names? of .{1,120}? nor the names of (?:its|their|any|the) contributors\b")
#: Every copyright statement has one of these.
_SIGNS = re.compile(r"copyright|\(c\)|©|all rights reserved", re.I)
_WORDS = re.compile(r"[^\W_]+")
_SAME = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, SPELLINGS), key=len, reverse=True)) + r")\b")
#: A text without any of these words has no spelling to make equal.
_FIRST = frozenset(k.split()[0] for k in SPELLINGS)


def canonical(text: str | None) -> str:
    """Lower case, no copyright statements, words parted by single blanks, spellings and the name in BSD's third condition made equal."""
    if not text:
        return ""
    words = _WORDS.findall((_COPYRIGHT.sub("", text) if _SIGNS.search(text) else text).casefold())
    t = " ".join(words)
    if not _FIRST.isdisjoint(words):
        t = _SAME.sub(lambda m: SPELLINGS[m.group()], t)
    return _CONTRIBUTORS.sub("neither the name of the copyright holder nor the names of its contributors", t) if "nor the names of" in t else t


def digest(text: str | None) -> str | None:
    c = canonical(text)
    return hashlib.sha256(c.encode()).hexdigest() if c else None


# fixed values: licence notices and short licence texts
KNOWN = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


# fixed values: titles that texts without one of their own are distributed with
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Zlib": ["zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "The BSD License"],
    "CC0-1.0": ["CC0 1.0 Universal"], "Unlicense": ["The Unlicense"],
}
_END = "END OF TERMS AND CONDITIONS"
_NUMBER = re.compile(r"^[ \t]*[0-9]\.[ \t]", re.M)


def known_digests() -> list[tuple[str, str]]:
    """(license, digest) of KNOWN and of the files in the folder licenses, named after their licences (.regents: another wording)."""
    texts = [*KNOWN.items()]
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        texts.append((path.stem.removesuffix(".regents"), path.read_text(encoding="utf-8")))
    out = set()
    for name, text in texts:
        forms = [text]
        if _END in text:  # without the appendix on how to apply the terms
            forms += [text[: text.index(_END)], text[: text.index(_END) + len(_END)]]
        if name.startswith("BSD") or name == "Zlib":
            forms.append(_NUMBER.sub("", text))
        forms += [f"{title}\n\n{f}" for f in forms for title in TITLES.get(name, [])]
        out |= {(name, digest(f)) for x in forms for f in (x, " ".join(x.split()))}
    return sorted(out)


def scan(docs: DataFrame, known: Mapping[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, digest (sha256 of the canonical form; null if that is empty) and license (null: none) of every row.

    known maps names to texts, or is a DataFrame (license, digest); without it the known_digests() hold. Of known licences with one digest the smallest name holds.
    Null and empty texts have no digest and no licence; repeated rows are looked up each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = named(docs, row_id=id_col, text=text_col)
    kind = docs.schema["row_id"].dataType.simpleString()
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(known_digests() if known is None else [(k, digest(v)) for k, v in known.items()], "license string, digest string")
    table = named(known, license="license", digest="digest").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(t.as_py()) for t in batch.column(1)], pa.string())], names=["row_id", "digest"])

    found = docs.mapInArrow(run, f"row_id {kind}, digest string")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return found.join(table, "digest", "left").select(F.col("row_id").alias(id_col), "digest", "license")
