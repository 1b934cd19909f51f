"""Scanning documents for license texts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.components import small
from brindle.llm.sizes import GAP
from brindle.session import materialize, scratch

#: Words of a shingle, and the share of a template's shingles that a match has to have.
SHINGLE, LEAST = 5, 0.75
#: Shingles of a window of text, and how far the next window starts. A template's windows are taken at
#: every place, so five shingles in a row that are the template's hold a window equal to one of its own,
#: which collides with it in every band for certain.
WINDOW, STRIDE = 4, 2
#: Bands of one row. Windows of similarity s collide in one of them with chance 1 - (1 - s)^4: 94 % at
#: 0.5, 97 % at 0.6 and 99.6 % at 0.75. A text that has 0.75 of a template in pieces of up to four shingles
#: has many such windows, each with a chance of its own.
BANDS = 4
#: Templates with fewer shingles are looked for in windows of one shingle, which collide if equal.
SHORT = 5
#: Characters that don't count.
IGNORED = ".,;:()\"'"

_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GRANT_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_WARRANTY_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Short notices, and the whole texts of permissive licenses and of the notices that longer
#: licenses ask for. Any other library of texts can be given instead.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": f"{_GRANT_MIT} {_WARRANTY_MIT}",
    "MIT-grant": _GRANT_MIT,
    "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. ' + _WARRANTY_MIT,
    "ISC": f"{_GRANT_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY_ISC}",
    "0BSD": f"{_GRANT_ISC}. {_WARRANTY_ISC}",
    "BSD-2-Clause": f"{_BSD} {_WARRANTY_BSD}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WARRANTY_BSD}",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
}


def words(text: Column) -> Column:
    """Words in lower case (A to Z) without the characters that don't count."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(text, upper + IGNORED, upper.lower()), GAP), "")


def shingle_hash(w: Column, i: Column) -> Column:
    """The hash of the shingle at a position, or null where none starts."""
    return F.when(i <= F.size(w) - SHINGLE, F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))


def shingle_text(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(SHINGLE)])


def band_keys(w: Column, start: Column) -> list[Column]:
    """For each band the least permuted hash of a window's shingles."""
    return [F.least(*[F.when(i <= F.size(w) - SHINGLE, F.xxhash64(F.lit(j), shingle_hash(w, i))) for i in (start + k for k in range(WINDOW))]) for j in range(BANDS)]


def single_key(h: Column) -> Column:
    """The key of a window of one shingle."""
    return F.xxhash64(F.lit(BANDS), h)


def shingled(texts: DataFrame) -> DataFrame:
    """The words ``w`` of each text once for each position ``p`` where a shingle starts; one pass without lambdas."""
    # posexplode_outer: for the plain one the optimizer would compute the words once more, in a filter
    return texts.select("*", F.posexplode_outer("w").alias("p", "_word")).drop("_word").filter(F.col("p") <= F.size("w") - SHINGLE)


def library(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Two written tables of templates: license, shingles (how many different ones), short, item and hash of each
    of them, and license and key of each band of each window."""
    if not templates:
        raise ValueError("no templates")
    w = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    empty = sorted(r["license"] for r in w.filter(F.size("w") < SHINGLE).select("license").collect())
    if empty:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {empty}")
    short = F.size("w") - SHINGLE + 1 < SHORT
    places = shingled(w)
    items = places.select("license", short.alias("short"), shingle_text(F.col("w"), F.col("p")).alias("item"), shingle_hash(F.col("w"), F.col("p")).alias("hash")).distinct()
    items = items.join(items.groupBy(F.col("license").alias("_license")).agg(F.count("*").alias("shingles")), F.col("license") == F.col("_license")).drop("_license")
    keys = F.when(short, F.array(single_key(shingle_hash(F.col("w"), F.col("p"))))).when(F.col("p") <= F.size("w") - SHINGLE - WINDOW + 1, F.array(*band_keys(F.col("w"), F.col("p"))))
    return materialize(items, "items"), materialize(places.select("license", F.explode(keys).alias("key")).distinct(), "keys")


def licensed(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Licenses found in the whole text of each document.

    Returns doc_id, license, found and shingles (of the template, found and in all) and word (position
    of the first shingle found, from 0), a row for each document and template where found is at least
    three quarters. MinHash bands of overlapping windows retrieve templates; the containment of the
    template's shingles of five words in the text then decides, on the words themselves.

    A window collides with a template's only in a shingle that both have, so bands are made only of windows
    that hold a shingle of the library: each position of a text is looked up by its hash in the table of all
    templates' shingles, which is broadcast after its rows are counted. That one pass over the texts needs
    neither a shuffle nor a lambda, and its plan doesn't depend on the number of templates. What it finds is
    written, and the rest works on that alone.

    A text whose part of a template has five shingles in a row is found for certain, and one without only
    with high probability, see ``BANDS``.

    Defined results: texts that are null, empty or shorter than five words have no row; a text of any length
    is read whole; a license that occurs several times in a text has one row; repeated rows repeat, and so do
    rows without a doc_id; of several licenses in a text each has its row, also where one holds another; an
    empty table gives no rows; other columns may have any names.
    """
    spark = docs.sparkSession
    with scratch() as keep:
        items, keys = library(spark, TEMPLATES if templates is None else templates)
        texts = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), words(F.col("text")).alias("w"))
        w, p = F.col("w"), F.col("p")
        places = shingled(texts).withColumn("_hash", F.xxhash64(*[F.get(w, p + j) for j in range(SHINGLE)]))
        # of the text only the words of the windows around a hit go on
        start = p - p % STRIDE
        near = F.slice(w, F.greatest(start - STRIDE, F.lit(0)) + 1, F.lit(STRIDE + WINDOW - 1 + SHINGLE))
        hits = places.join(small(items), F.col("_hash") == F.col("hash")).select("uid", "doc_id", "license", "shingles", "short", "hash", "item", "p", near.alias("near"))
        hits = materialize(hits, "hits")
        before, near = F.when(start >= STRIDE, F.lit(STRIDE)).otherwise(F.lit(0)), F.col("near")
        windows = F.concat(F.array(*band_keys(near, before)), F.when(start >= STRIDE, F.array(*band_keys(near, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
        keys_of = F.when(F.col("short"), F.array(single_key(F.col("hash")))).otherwise(windows)
        hits = hits.filter(F.col("item") == shingle_text(near, before + p % STRIDE))
        retrieved = hits.select("uid", F.explode(keys_of).alias("key")).distinct().join(small(keys), "key").select(F.col("uid").alias("_uid"), F.col("license").alias("_license")).distinct()
        checked = hits.join(retrieved, (F.col("uid") == F.col("_uid")) & (F.col("license") == F.col("_license")), "left_semi")
        found = checked.groupBy("uid", "license").agg(F.first("doc_id").alias("doc_id"), F.first("shingles").alias("shingles"), F.countDistinct("item").alias("found"), F.min("p").cast("bigint").alias("word"))
        return keep(materialize(found.filter(F.col("found") >= LEAST * F.col("shingles")).select("doc_id", "license", "found", "shingles", "word"), "licenses"))
