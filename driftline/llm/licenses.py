"""Licence scans by canonical digests of entire texts (operator 4), DataFrame functions only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines and
equivalent spellings removed from the comparison) and digested; the digest is joined with
those of known licences.  The table of known licences is part of the program, so its
broadcast does not grow with the data.  Every line is looked up the same way; only the length
of its canonical form, which equal forms share, is compared before it is digested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence texts and notices: identifier, text.
KNOWN = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "MIT-0",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "AGPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Unlicense", "Released under the Unlicense."),
)
#: Titles that may stand above the whole texts of these licences.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT"),
    ("ISC", "ISC License"),
    ("ISC", "The ISC License"),
    ("ISC", "ISC License (ISC)"),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("Zlib", "zlib License"),
    ("Zlib", "The zlib License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "The BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "The BSD 3-Clause License"),
    ("MIT-0", "MIT No Attribution"),
    ("Unlicense", "The Unlicense"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Boost Software License 1.0"),
)
#: Digests of the canonical forms of long licences, whole as their authors publish them, and (Apache, GPL) without the appendix on how to apply them; fixed values.
DIGESTS = (
    ("Apache-2.0", "37aa90548985ac0057637d42c3153e8b5d107a21d9556d7fbe60e3e426fdacaa", 8867),
    ("Apache-2.0", "4f4efc99b21676427023f964ba9cf67d7063cce2d807400514641d03c8fc64e3", 9922),
    ("Apache-2.0", "9ce71eb31a8abf79414c431def165019f9604548c79edc94fe0d7d50b2f8703e", 8839),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a", 5823),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127", 19582),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985", 22012),
    ("GPL-1.0", "3c796b04cfbd58d45e505bbfd656f39ed02b0e66f4b7768a6c92eb29931304c8", 9385),
    ("GPL-1.0", "6c07dfb5e6ddc39fe93ae803d39b67367c21b50207b645111c04cd08cb283d70", 9413),
    ("GPL-1.0", "ecede0ce378cc2fefec4431f4cf508af5338dc8a3e44b5c5a3a7867070db5798", 11763),
    ("GPL-2.0", "b1a13b5262988058eb24fa2ecc2451ae813514d152b9361d66a115e43a210bf9", 14452),
    ("GPL-2.0", "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f", 17114),
    ("GPL-2.0", "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632", 14480),
    ("GPL-3.0", "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1", 33398),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", 30957),
    ("GPL-3.0", "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153", 30929),
    ("LGPL-2.0", "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c", 22245),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389", 22273),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", 24126),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97", 23361),
    ("LGPL-2.1", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30", 23333),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", 25213),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "557aed17f246818803a7e59ebc965e6771b9df3a92fb2f3598e38d288d65fe4c", 22449),
    ("MPL-2.0", "2ae5d4417f09cff2e3412d0e35c4ee2439f6c18ca69d7d9cc799b33614c368a5", 14342),
)

#: Spellings that count as one; fixed values, lower case.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: A line of a copyright notice: the word or (c) and a year, the word with (c) or the sign, the sign, or the rights phrase.
COPYRIGHT_LINE = r"(?md)^[^\p{L}\n]*(?:(?:copyright|\(c\))[^\n]*\d{4}[^\n]*|copyright[^\p{L}\n]*(?:\(c\)|©)[^\n]*|©[^\n]*|all rights reserved\.?[^\p{L}\n]*)$"
#: Spellings of one word, and of several, which may stand on two lines.
WORDS = tuple(x for x in EQUIVALENT if " " not in x[0])
PHRASES = tuple(x for x in EQUIVALENT if " " in x[0])


def _respelled(c: Column, spellings) -> Column:
    """One spelling for each word or phrase between spaces; the replacements run only on texts that have any to replace."""
    out = c
    for other, one in spellings:
        # twice, as a hit takes the space that the next one needs
        out = F.replace(F.replace(out, F.lit(f" {other} "), F.lit(f" {one} ")), F.lit(f" {other} "), F.lit(f" {one} "))
    by_initial: dict[str, list[str]] = {}
    for other, _ in spellings:
        by_initial.setdefault(other[0], []).append(other[1:])
    some = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by_initial.items()))
    return F.when(c.rlike(f" (?:{some}) "), out).otherwise(c)


def _canonical(df: DataFrame, text: str) -> DataFrame:
    """``df`` with _lines, the canonical forms of all lines, and _whole, that of the whole text."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(f"`{text}`"), COPYRIGHT_LINE, " "), r"[^\p{L}\p{N}\n]+", " ")
    spaced = F.concat(F.lit(" "), F.replace(bare, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    # a step each, so that no expression is worked out twice
    return (
        df.withColumn("_spaced", spaced)
        .withColumn("_spaced", _respelled(F.col("_spaced"), WORDS))
        .withColumn("_spaced", _respelled(F.col("_spaced"), PHRASES))
        .withColumn("_whole", F.regexp_replace("_spaced", "[ \n]+", " "))
        .withColumn("_whole", F.btrim(_respelled(F.col("_whole"), PHRASES), F.lit(" ")))
        .withColumn("_lines", F.transform(F.split("_spaced", "\n", -1), lambda x: F.btrim(F.regexp_replace(x, " +", " "), F.lit(" "))))
        .drop("_spaced")
    )


def known_texts() -> list[tuple[str, str]]:
    """The known texts, with and without their titles, and with dashes for their numbers."""
    rows = list(KNOWN)
    for name, text in KNOWN:
        if "\n" in text:
            rows += [(name, f"{title}\n\n{text}") for other, title in TITLES if other == name]
    return rows + [(name, text.replace("\n1. ", "\n- ").replace("\n2. ", "\n- ").replace("\n3. ", "\n- ")) for name, text in rows if "\n1. " in text]


def known_digests(spark: SparkSession, known=None) -> dict[str, tuple[str, int]]:
    """Licence and length by digest; two licences that claim a digest give the smaller name.  By default the program's own table."""
    rows = known_texts() if known is None else list(known)
    own = _canonical(spark.createDataFrame(rows, "name string, text string"), "text").where("_whole <> ''")
    out = {digest: (name, int(size)) for name, digest, size in (DIGESTS if known is None else ())}
    for r in own.select("name", F.sha2("_whole", 256).alias("digest"), F.length("_whole").alias("size")).collect():  # rows of the program
        out[r["digest"]] = min((r["name"], r["size"]), out.get(r["digest"], (r["name"], r["size"])))
    return out


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", known=None) -> DataFrame:
    """One row for each row of ``docs``: id, n_canonical, digest, license_id, n_license_lines, line_licenses.

    ``digest`` is the SHA-256 of the whole text's canonical form and ``license_id`` the known
    licence with that digest, null if none.  The same lookup over each line's canonical form
    gives ``line_licenses``, the sorted distinct licences of the lines, and their number
    of lines; lines of any length are looked up.  ``known`` are pairs of a name and a text, by
    default the program's own.  Null text: null digest, no licence; a text or line that is
    empty in canonical form is no licence.  Rows are independent, so ids may repeat or be null;
    other columns are ignored.
    """
    spark = docs.sparkSession
    found = known_digests(spark, known)
    digests = spark.createDataFrame([(d, name) for d, (name, _) in sorted(found.items())], "_known string, _license string")
    by_digest = F.create_map(*[F.lit(x) for d, (name, _) in sorted(found.items()) for x in (d, name)]).cast("map<string,string>")
    sizes = F.lit(sorted({n for _, n in found.values()}) or [-1])
    own = docs.select(F.col(f"`{id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    return (
        _canonical(own, "_text")
        .withColumn("_lines", F.filter("_lines", lambda x: F.array_contains(sizes, F.length(x))))
        .select(
            "_doc",
            F.sha2("_whole", 256).alias("_digest"),
            F.length("_whole").cast("long").alias("_n"),
            F.filter(F.transform(F.coalesce("_lines", F.array().cast("array<string>")), lambda x: F.try_element_at(by_digest, F.sha2(x, 256))), lambda x: x.isNotNull()).alias("_hits"),
        )
        .join(F.broadcast(digests), F.col("_digest") == F.col("_known"), "left")
        .select(
            F.col("_doc").alias(id),
            F.col("_n").alias("n_canonical"),
            F.col("_digest").alias("digest"),
            F.col("_license").alias("license_id"),
            F.size("_hits").cast("long").alias("n_license_lines"),
            F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("line_licenses"),
        )
    )
