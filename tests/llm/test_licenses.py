"""Licence scans against a plain version."""

import math
import re
from collections import Counter

import pytest

from vecloom.llm import licenses

SF = "/root/testdata/sf0.01"


def terms(text):
    return re.findall(licenses.TERM, text.lower())


def plain(files, min_cosine=licenses.MIN_COSINE, license_file=licenses.LICENSE_FILE):
    vocabulary = {t for _, x in licenses.TEMPLATES for t in terms(x)}
    total = len(files)
    df = Counter(t for _, _, x in files for t in set(terms(x or "")) & vocabulary)
    idf = lambda t: math.log((total + 1) / (df[t] + 1)) + 1 if t in vocabulary else math.log(total + 1) + 1
    weigh = lambda words: {t: n * idf(t) for t, n in Counter(words).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, weigh(terms(x))) for name, x in licenses.TEMPLATES]
    own = []
    for _, path, text in files:
        text = text or ""
        units = [(u, True) for u in text.split("\n")]
        units += [(u, False) for u in re.split("\n[ \t\r]*\n", text) if "\n" in u]
        if re.search(licenses.FILE_NAME, path or "") or re.search(licenses.WHOLE, text.lower()):
            units.append((text, False))
        best, covered = None, 0
        for u, is_line in units:
            low = u.lower()
            if not re.search(licenses.MENTIONS, low) or re.search(licenses.DENIALS, low):
                continue
            v = weigh(terms(u))
            scores = {}
            for name, t in templates:
                dot = sum(x * t.get(k, 0) for k, x in v.items())
                score = round(dot / (size(v) * size(t)), 9) if v else 0
                if any(re.search("[0-9]", k) and k not in v for k in t):
                    continue
                scores[name] = max(scores.get(name, 0), score)
            first, second = sorted([(0, ""), (0, "")] + [(x, n) for n, x in scores.items()])[:-3:-1]
            if first[0] >= min_cosine:
                covered += len(terms(u)) * is_line
                found = (round(first[0] - second[0], 9) >= licenses.MARGIN, *first)
                if best is None or found[:2] > best[:2]:
                    best = found
        covered = covered / len(terms(text)) if covered else 0
        own.append((best, 1 if re.search(licenses.FILE_NAME, path or "") else covered))
    dirs = {}
    for (best, covered), (_, path, _) in zip(own, files):
        if covered >= license_file and path is not None:
            d, clear = path.rpartition("/")[0], bool(best and best[0])
            name = best[2] if clear else ""
            dirs.setdefault(d, []).append((clear, covered, best[1] if best else 0, name))
    out = []
    for (best, _), (i, path, _) in zip(own, files):
        if best:
            clear = (best[2], "file") if best[0] else (None, "unclear")
            out.append((i, *clear, round(best[1], 6), None))
            continue
        d, found = (path or "").rpartition("/")[0], None
        while path is not None:
            if d in dirs:
                name = max(dirs[d])[3] or None
                found = (name, "directory" if name else None, None, d)
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out.append((i, *(found or (None, None, None, None))))
    return sorted(out, key=repr)


def scanned(df, **options):
    rows = licenses.scan(df, **options).collect()
    return sorted(
        ((r.id, r.license, r.basis, None if r.score is None else round(r.score, 6), r.from_dir) for r in rows),
        key=repr,
    )


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = docs.selectExpr(
        "doc_id AS id",
        "concat_ws('/', source, lang, doc_id div 100, if(doc_id % 100 = 3, 'LICENSE', string(doc_id))) AS path",
        "text",
    )
    files = [(r.id, r.path, r.text) for r in df.collect()]
    for share in (licenses.LICENSE_FILE, 0.2):
        assert scanned(df, license_file=share) == plain(files, license_file=share)
    named = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    found = {i: x for i, x, basis, _, _ in scanned(df) if basis == "file"}
    for i, _, text in files:
        wanted = {v for k, v in named.items() if k in text.split("\n")}
        assert (found.get(i) in wanted) if wanted else i not in found


MIT_BODY = licenses.MIT_GRANT


def test_tree(spark):
    rows = [
        (1, "a/LICENSE", "The MIT License\n\n" + MIT_BODY.replace(", to deal", ",\nto deal") + "\n"),
        (2, "a/b/c/x.py", "print(1)"),
        (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/y.py", "# SPDX-License-Identifier: GPL-3.0\ncode\n" + "word " * 50),
        (5, "a/z.py", None),
        (6, "top.py", ""),
        (7, None, "Released under the MIT License."),
        (8, None, "nothing"),
        (9, "other/deep/er/f", "the licence of this text is unclear " + "w " * 40_000),
        (9, "other/deep/er/f", "the licence of this text is unclear " + "w " * 40_000),
        (10, "a/b/c/d/e", "x"),
        (11, "a//q", "x"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    df = df.selectExpr("*", "'clash' AS row", "1 AS words", "'u' AS dir")
    got = scanned(df)
    assert got == plain(rows)
    found = {r[0]: r[1:3] + r[4:] for r in got}
    assert found[2] == ("Apache-2.0", "directory", "a/b")
    assert found[5] == ("MIT", "directory", "a")
    assert found[4][:2] == ("GPL-3.0", "file")
    assert found[6][0] is None and found[8][0] is None and found[9][0] is None
    assert scanned(df.filter("id = 0")) == []


@pytest.mark.parametrize("path,wanted", [("a/b/c", "a/b"), ("c", ""), ("/c", ""), ("a/", "a")])
def test_directory(spark, path, wanted):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(licenses.directory(F.col("path"))).first()[0] == wanted


def test_scan_stays_in_the_engine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "source AS path", "text")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


MIT_TEXT = (
    "MIT License\n\nCopyright (c) 2024 A\n\n" + MIT_BODY + "\n\nThe above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
)
BSD_WORDS = (
    "Copyright (c) 2024, A\n\nRedistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.\n"
)
THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission.\n\n"
)
ISC_TEXT = f"ISC License\n\nCopyright (c) 2024 A\n\n{licenses.ISC_GRANT}, provided that {licenses.ISC_NOTICE}\n\n{licenses.ISC_WARRANTY}\n"
APACHE_TEXT = (
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n"
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n"
    '"License" shall mean the terms and conditions for use, reproduction, and distribution as '
    "defined by Sections 1 through 9 of this document.\n\n" + "Subject to the terms of this License. " * 60
)
BANNER = "=" * 300 + "\nA project of many people, with thanks to all of them. " * 6 + "\n\n"
GPL_HEAD = BANNER + "GNU {} PUBLIC LICENSE\n{}\n\nCopyright (C) Free Software Foundation\n\n" + "terms " * 900


def wrapped(text):
    import textwrap

    return "\n\n".join(textwrap.fill(p, 72) for p in text.split("\n\n"))


@pytest.mark.parametrize("layout", [str, wrapped])
def test_full_texts_hold_for_their_directories(spark, layout):
    texts = {
        "mit/LICENSE": ("MIT", MIT_TEXT),
        "bsd3/LICENSE.txt": ("BSD-3-Clause", BSD_WORDS.format(THIRD)),
        "bsd2/LICENCE.md": ("BSD-2-Clause", BSD_WORDS.format("")),
        "isc/COPYING": ("ISC", ISC_TEXT),
        "apache/LICENSE-APACHE": ("Apache-2.0", APACHE_TEXT),
        "gpl2/COPYING": ("GPL-2.0", GPL_HEAD.format("GENERAL", "Version 2, June 1991")),
        "gpl3/COPYING": ("GPL-3.0", GPL_HEAD.format("GENERAL", "Version 3, 29 June 2007")),
        "lgpl3/COPYING": ("LGPL-3.0", GPL_HEAD.format("LESSER GENERAL", "Version 3, 29 June 2007")),
        "agpl/LICENSE": ("AGPL-3.0", GPL_HEAD.format("AFFERO GENERAL", "Version 3, 19 November 2007")),
        "sa/LICENSE": (
            "CC-BY-SA-4.0",
            "Creative Commons Attribution-ShareAlike 4.0 International Public License\n\nBy exercising",
        ),
    }
    rows = [(p, p, layout(text) if "COPYING" not in p else text) for p, (_, text) in texts.items()]
    rows += [(f"{p.split('/')[0]}/src/x.py",) * 2 + ("print(1)",) for p in texts]
    # A licence file that names none ends the search, one that denies a licence too.
    own = "see gnu general public license version 3 29 june 2007 for the licence we do NOT use"
    rows += [("mit/none/LICENSE",) * 2 + ("all rights reserved",), ("mit/none/x",) * 2 + ("y",)]
    rows += [("own/LICENSE",) * 2 + (own + "; this project is proprietary",), ("own/x",) * 2 + ("y",)]
    # Most files of a tree are code.
    rows += [(f"code/{i}",) * 2 + ("int main() { return 0; }",) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, path string, text string")
    found = {r[0]: r[1:3] for r in scanned(df)}
    for path, (name, _) in texts.items():
        assert found[path] == (name, "file"), path
        assert found[f"{path.split('/')[0]}/src/x.py"] == (name, "directory")
    for path in ("mit/none/x", "own/x", "own/LICENSE", "mit/none/LICENSE"):
        assert found[path] == (None, None), path


def test_relatives_denials_and_unclear_notices(spark):
    notice = dict((n, t) for n, t in licenses.NOTICES if "free software" in t)
    rows = [
        ("This project is not licensed under the MIT License.", None),
        ("This code isn't released under the MIT License", None),
        ("we do not use the MIT License, all rights reserved", None),
        ("no longer distributed under the MIT license", None),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("// SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0"),
        ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"),
        ("SPDX-License-Identifier: ISC", "ISC"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
         "International License.", "CC-BY-SA-4.0"),
        (licenses.BSD_SENTENCE, "unclear"),
        ("This work is licensed under the GNU General Public License.", None),
        *[(f"# {text}", name) for name, text in notice.items()],
        *[(wrapped(text).replace("\n", "\n# "), name) for name, text in notice.items()],
    ]
    files = [(i, f"{i}/x.c", f"// file {i}\n\n{text}\n\nint x;") for i, (text, _) in enumerate(rows)]
    files += [(1000 + i, "code/x.c", "the code of a file, and of this one") for i in range(300)]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = scanned(df)
    assert got == plain(files)
    found = {r[0]: r[1:3] for r in got}
    for i, (text, wanted) in enumerate(rows):
        if wanted in (None, "unclear"):
            assert found[i] == (None, wanted), text
        else:
            assert found[i] == (wanted, "file"), text


def test_licence_file_names():
    names = ["LICENSE", "a/COPYING", "a/licence.md", "LICENSE-MIT", "LICENSE-APACHE-2.0.txt", "COPYING.LESSER"]
    assert all(re.search(licenses.FILE_NAME, n) for n in names)
    others = ["license.py", "a/license-checker.js", "LICENSE-mit.go", "mylicense", "LICENSE/x", "copyings"]
    assert not any(re.search(licenses.FILE_NAME, n) for n in others)
