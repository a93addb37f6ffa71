"""Licence detection by canonical digests of entire texts.

A text is put in canonical form - lower case, copyright and title lines dropped, punctuation and spacing levelled, equivalent
spellings made one - and its SHA-256 is looked up among the digests of known licences. The same is done for each line,
as a licence notice is a line that is wholly the notice. Only column functions are used, row by row, with no shuffle.

Null and empty texts have no licence and no notices; repeated rows and paths give repeated results. Of several names for
one text the first in the list is given. The known texts are a fixed list, so their table is broadcast.
"""

from __future__ import annotations

import hashlib
import re

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm import license_table

#: Pairs of equivalent spellings (first becomes second).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "owner": "holder", "owners": "holders",
}

#: Licence texts and one-line notices, each a whole text.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

#: Of each licence its texts and of each notice its wordings: those above, whole texts in usual editions, more notices.
EDITIONS = license_table.editions(KNOWN)


def _texts(known: dict) -> list[tuple[str, str]]:
    return [(name, t) for name, texts in known.items() for t in ([texts] if isinstance(texts, str) else texts)]


#: A line that only says whose the copyright is, or is a title. Matched on lower-cased text.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*((\(c\)|©|copyright[ \t]*(\(c\)|©|:|[0-9]|<|\[|by )|all rights reserved)[^\n]*$" + f"|{license_table.name_line([t for _, t in _texts(EDITIONS)])}|{license_table.title_line()})"
#: What separates words: anything but letters, marks that go with them, and digits, of any script.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def canonical_words(text: Column) -> Column:
    """Words of the canonical form before spellings are levelled."""
    low = F.lower(text)
    low = F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved|licen[cs]e"), F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _spell(words: Column) -> Column:
    level = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(level[w], w)), " ")


def canonical_text(text: str) -> str:
    """The canonical form of one known text (the list of known texts is small and fixed)."""
    low = re.sub(COPYRIGHT_LINE, " ", text.lower())
    return " ".join(SPELLINGS.get(w, w) for w in regex.split(NOT_WORD, low) if w)


def known_digests(known: dict[str, str | tuple[str, ...]] = EDITIONS) -> dict[str, str]:
    """Digest to licence; of two names for one text the first is kept."""
    out: dict[str, str] = {}
    for name, text in _texts(known):
        out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return out


def digest(text: Column, lengths: set[int]) -> Column:
    """SHA-256 of the canonical form if it has as many words as one of the known texts, else null: no such text can match."""
    words = canonical_words(text)
    return F.when(F.size(words).isin(*sorted(lengths)), F.sha2(_spell(words), 256))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", known: dict[str, str | tuple[str, ...]] = EDITIONS) -> DataFrame:
    """(path, license, notices) of each row: the licence that the whole text is, and those that single lines are."""
    spark, names = files.sparkSession, known_digests(known)
    lengths = {len(canonical_text(t).split(" ")) for _, t in _texts(known)}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    table = F.broadcast(spark.createDataFrame(list(names.items()), "digest string, license string"))
    # a line without one of these words is no notice of the list
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.lower(x).rlike("licen|permission|warrant"))
    notices = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: lookup[digest(x, lengths)]), lambda n: n.isNotNull())))
    rows = files.select(F.col(path).alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("path", digest(F.col("text"), lengths).alias("digest"), F.array_join(notices, ",").alias("notices"))
    return rows.join(table, "digest", "left").select("path", "license", "notices")
