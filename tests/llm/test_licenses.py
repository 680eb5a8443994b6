import math
import random
import re
import textwrap
from collections import Counter

import pytest

from corpusmill.llm import licenses as L

SCHEMA = "path string, doc_id long, text string, license string, dir int, id array<int>"
BODY = "some words that stand for the body of a file\nand more of them in another line\n"
FILES = [
    ("a/LICENSE", 1, "Licensed under the Apache License, Version 2.0\nsee the terms and conditions of use and so on and so forth"),
    ("a/x.py", 2, BODY), ("a/b/c/y.py", 3, BODY), ("a/b/c/own.py", 4, "# Released under the MIT License.\n" + BODY),
    ("a/b/NOTICE.txt", 5, "This work is licensed under the GNU General Public License, version 3."), ("a/b/z.py", 6, BODY), ("ab/x.py", 7, BODY),
    ("x.py", 8, BODY), ("a/b2/COPYING", 9, "no notice"), ("a/b2/q.py", 10, None), ("a/b2/r.py", 11, ""), (None, 12, BODY),
    ("a/two.py", 13, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved.\n" + BODY), ("/abs/LICENCE.md", 14, "Licensed under the MIT License"), ("/abs/d/e", 15, BODY),
    ("m/n", 16, "w " * 60_000 + "\nAll rights reserved.\n"), ("m/license files of ours", 17, "the license of this library is a matter of taste"), ("a/x.py", 2, BODY), ("k/s", None, "SPDX-License-Identifier: MIT\n" + BODY),
]


def words(text):
    return re.findall(rb"[a-z0-9]+(?:\.[0-9]+)*|[^\x00-\x7f]+", text.lower())


def brute_headers(text):
    """All stretches of lines, kept if they are one of the four kinds."""
    lines = text.split(b"\n")
    solid, cue = [bool(x.strip()) for x in lines], [bool(x.strip() and L.CUE.search(x)) for x in lines]
    block, n = [], 0  # the paragraph of each line
    for k, x in enumerate(solid):
        n += x and (k == 0 or not solid[k - 1])
        block.append(n if x else None)
    marked = {b for b, c in zip(block, cue, strict=True) if c}
    out = [x for x, c in zip(lines, cue, strict=True) if c]
    for i in range(len(lines)):
        for j in range(i + 2, len(lines) + 1):
            own = [k for k in range(i, j) if solid[k]]
            if not (solid[i] and solid[j - 1]) or len(own) < 2:
                continue
            before, after = [k for k in range(i) if solid[k]][-1:], [k for k in range(j, len(lines)) if solid[k]][:1]
            joined = b"\n".join(lines[k] for k in own)
            if sum(len(lines[k]) for k in own) > L.NOTICE:
                continue
            run = all(cue[k] for k in own) and not any(cue[k] for k in before + after)
            whole = not any(block[k] == block[i] for k in before) and not any(block[k] == block[j - 1] for k in after)
            blocks = {block[k] for k in own}
            one = whole and len(blocks) == 1 and blocks <= marked
            several = whole and len(blocks) > 1 and blocks <= marked and not any(block[k] in marked for k in before + after)
            if run or one or several:
                out.append(joined)
    return list(dict.fromkeys(out))


def test_headers_match_brute_force():
    rng = random.Random(7)
    kinds = [b"", b"  ", b"plain words", b"# the MIT License", b"Copyright (c) 2020", b"more"]
    for _ in range(400):
        text = b"\n".join(rng.choices(kinds, k=rng.randrange(12)))
        assert set(L.headers(text)) == set(brute_headers(text)), text
    assert L.headers(b"License\n" + b"x" * L.NOTICE) == [b"License"]


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0"])
def test_wrapped_texts(spark, name):
    """A license's text wrapped into lines and paragraphs is a license file by what it says; so is a wrapped comment's notice found."""
    whole = max(L.TEMPLATES[name], key=len)
    wrapped = textwrap.fill(whole, 60).replace("Copyright (c)", "\n\nCopyright (c) 2021 Jane Roe\n\n")
    comment = textwrap.indent(textwrap.fill(L.TEMPLATES[name][-2] if name == "MIT" else whole, 50), " * ") + "\n\n" + BODY * 5
    rows = [("p/texts/one", 1, wrapped, "l", 1, []), ("p/texts/d/code", 2, BODY, "l", 1, []), ("q/code.c", 3, comment, "l", 1, []), ("q/other", 4, BODY, "l", 1, [])]
    rows += [(f"r/{i}", 10 + i, f"words of the file {i} and of all the others in any of them", "l", 1, []) for i in range(60)]
    got = {r["doc_id"]: r for r in L.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["license"] for i in (1, 2, 3, 4)] == [name, name, name, None]
    assert got[2]["from_dir"] == "p/texts"


def brute(rows):
    n = len(rows)
    seen = Counter(t for _, _, text in rows for t in set(words((text or "").encode())))
    idf = lambda t: math.log((1 + n) / (1 + seen[t])) + 1

    def cosine(a, b):
        a, b = Counter(words(a)), Counter(words(b))
        dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a)
        return dot / math.sqrt(sum((c * idf(t)) ** 2 for t, c in a.items()) * sum((c * idf(t)) ** 2 for t, c in b.items())) if a else 0

    own = []
    for path, doc, text in rows:
        found = [max((cosine(h, t.encode()), name) for name, notices in L.TEMPLATES.items() for t in notices) + (len(words(h)),) for h in brute_headers((text or "").encode())]
        found = [f for f in found if f[0] >= L.LEAST]
        score, name, size = max(found, default=(None, None, 0), key=lambda f: (f[0] * f[2], f[0]))
        whole = name is not None and score * size >= L.WHOLE * len(words((text or "").encode()))
        folder = path.rsplit("/", 1)[0] if path and "/" in path else ""
        own.append((doc, path, name, score, whole, folder))

    given = {}
    for _, path, name, score, whole, folder in own:
        if name and (whole or re.search(L.LICENSE_NAME, path or "")):
            given[folder] = max(given.get(folder, (0, "")), (score, name))
    out = []
    for doc, path, name, score, _, folder in own:
        parts = folder.split("/") if folder else []
        above = next((a for k in range(len(parts), -1, -1) if (a := "/".join(parts[:k])) in given), None)
        out.append((doc, path, name, name or (given[above][1] if above is not None else None), None if name else above))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(p, d, t, "l", 1, []) for p, d, t in FILES]
    got = L.license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["path"], r["own_license"], r["license"], r["from_dir"]) for r in got), key=str) == brute(FILES)
    license_of = {r["doc_id"]: r["license"] for r in got}
    assert [license_of[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 14, 15)] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", "MIT", "GPL-3.0", "GPL-3.0", None, None, "Apache-2.0", "MIT", "MIT"]
    assert license_of[16] == "Proprietary" and license_of[17] is None


@pytest.mark.parametrize("name", L.TEMPLATES)
def test_each_notice_is_its_license(name):
    vector = L.weigher(1000, {t: 50 for t in (b"the", b"of", b"and", b"to", b"in", b"a")})
    own = [(other, vector(L.terms(t.encode()))) for other, notices in L.TEMPLATES.items() for t in notices]
    for notice in L.TEMPLATES[name]:
        v = vector(L.terms(f"{notice}.".encode()))
        assert max(own, key=lambda o: sum(w * o[1].get(t, 0) for t, w in v.items()))[0] == name


def test_empty_table(spark):
    assert L.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_common_words_do_not_dilute(spark):
    """A header with words that many documents hold scores alike in a small and a large corpus."""
    header = "our project files licensed under the MIT License\n" + BODY
    scores = []
    for n in (100, 10_000):
        rows = [("f", 0, header, "l", 1, [])]
        rows += [(f"d/{i}", 1 + i, " ".join(w for k, w in enumerate(("the", "our", "project", "files", "under", "license", "licensed", "mit")) if i % 10 <= (9, 1, 1, 1, 3, 0, 0, 0)[k]), "l", 1, []) for i in range(n)]
        got = {r["doc_id"]: r for r in L.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got[0]["license"] == "MIT"
        scores.append(got[0]["own_score"])
    assert scores[0] == pytest.approx(scores[1], abs=0.05)


@pytest.mark.parametrize("license_", ["Apache-2.0", "GPL-2.0", "MIT"])
def test_notices_above_long_paragraphs(spark, license_):
    """A wrapped notice is found alike above a few lines and above tens of thousands without a blank line, also below them."""
    notice = textwrap.wrap(max(L.TEMPLATES[license_], key=len), 70)
    code = [f"x{i} = f(y{i}, {i})  # step {i}" for i in range(30_000)]
    texts = ["\n".join(notice + code[:2000]), "\n".join(code + notice), "\n".join(code[:9000] + notice + code[9000:]), "\n".join(code)]
    df = spark.createDataFrame([(f"f{i}.py", i, t, "", 0, []) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["own_license"], r["own_score"]) for r in L.license_scan(df).collect()}
    assert [got[i][0] for i in range(4)] == [license_] * 3 + [None]
    assert all(len(b"\n".join(L.headers(t.encode()))) > 0 and max(len(h.split(b"\n")) for h in L.headers(t.encode())) > 3 for t in texts[:3])


def test_stretches_cover_a_notice():
    lines = [b"code here"] * 5000 + [b"# the MIT license", b"# as is"] + [b"more code"] * 5000
    found = list(L.stretches(lines))
    assert lines[5000] in found[0] and all(b"MIT" in x for x in found)
    assert len(set(found)) > len(L.STRETCHES) and max(map(len, found)) < 20_000
