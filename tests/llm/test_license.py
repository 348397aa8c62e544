"""License scans: planted wordings are found, changed names and plain prose are not."""

import random
import re
import time
from difflib import SequenceMatcher

from odd import DOC_SCHEMA, odd_docs

from callweft.llm.license_scan import TEMPLATES, Scanner, license_scan


def prose(rng, lines):
    return [" ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 30))) for _ in range(lines)]


def wrapped(text, width=60):
    out, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return [*out, line]


def test_every_wording_is_found_where_it_stands(spark):
    rng = random.Random(2)
    texts, want = [], {}
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            for form in ([wording], wrapped(wording.upper())):
                before, after = prose(rng, rng.randint(0, 6)), prose(rng, rng.randint(3, 6))
                want[len(texts)] = (name, len("\n".join(before)) + bool(before))
                texts.append("\n".join([*before, *form, *after]))
    n = len(texts)
    texts += ["\n".join(prose(rng, 20)) for _ in range(50)]
    docs = odd_docs(spark, texts)
    found = {}
    for r in license_scan(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(range(n))
    for doc_id, (name, _) in want.items():
        assert [r.license for r in found[doc_id]] == [name], (texts[doc_id], found[doc_id])
        assert all(r.n_missing == 0 and r.saved > 0 for r in found[doc_id])
    assert sum(found[d][0].start == at for d, (_, at) in want.items()) > 0.8 * n


def test_near_wordings_are_told_apart():
    s = Scanner()
    assert s.scan("Licensed under CC BY 4.0.")[0][2] == "CC-BY-4.0"
    assert s.scan("Licensed under CC BY-NC 4.0.")[0][2] == "CC-BY-NC-4.0"
    assert s.scan("This work is licensed under the GNU General Public License, version 2.")[0][2] == "GPL-2.0"
    assert s.scan("The driver lost his license, and the court gave no permission to drive.") == []
    assert s.scan("Licensed under CC BY 9.9.") == s.scan("") == s.scan(None) == []
    two = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    assert [x[2] for x in s.scan(two)] == ["MIT", "CC-BY-NC-4.0"]


def test_every_license_of_a_block_is_found():
    s = Scanner()
    mit, bsd, apache = TEMPLATES["MIT"][2], TEMPLATES["BSD-3-Clause"][0], TEMPLATES["Apache-2.0"][1]
    cc = "Licensed under CC BY-NC 4.0."
    lines = lambda t: "\n".join(wrapped(t))
    cases = [
        (f"{lines(mit)}\n\n{lines(bsd)}", ["MIT", "BSD-3-Clause"]),
        (f"{lines(apache)}\n\n{lines(mit)}\n\n{lines(bsd)}", ["Apache-2.0", "MIT", "BSD-3-Clause"]),
        (f"{cc}\n{lines(mit)}\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT", "MIT"]),
        (f"Released under the MIT License. {cc}", ["MIT", "CC-BY-NC-4.0"]),
        (f"{mit} {bsd} {mit}", ["MIT", "BSD-3-Clause", "MIT"]),
    ]
    for text, names in cases:
        found = s.scan(text)
        assert [x[2] for x in found] == names, found
        assert all(x[4] == x[5] == 0 for x in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        wordings = {" ".join(w.split()) for name in names for w in TEMPLATES[name]}
        assert all(" ".join(text[x[0] : x[1]].split()) in wordings for x in found)


def test_added_name_words_make_another_license():
    s = Scanner()
    assert [x[2] for x in s.scan("This work is licensed under the GNU Lesser General Public License, version 3.")] == ["LGPL-3.0"]
    assert [x[2] for x in s.scan(TEMPLATES["GPL-3.0"][1].replace("General", "Affero General"))] == ["AGPL-3.0"]
    assert s.scan("This work is licensed under the GNU Library General Public License, version 3.") == []
    assert s.scan(TEMPLATES["GPL-3.0"][1].replace("General", "Library General")) == []


def test_many_licenses_take_linear_time():
    s, rng = Scanner(), random.Random(5)
    every = [(name, wording) for name, wordings in TEMPLATES.items() for wording in wordings]
    short = [(name, wording) for name, wording in every if len(wording.split()) < 20]
    for some, between, n in ((short, "\n", 5000), (every, "\n\n", 300), (short, " ", 300)):
        picks = [rng.choice(some) for _ in range(n)]
        at, want = 0, []
        for name, wording in picks:
            want.append((at, name))
            at += len(wording) + len(between)
        text = between.join(wording for _, wording in picks)
        began = time.time()
        found = s.scan(text)
        assert [(x[0], x[2]) for x in found] == want
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False)) and time.time() - began < 60
    notice = "Released under the MIT License."
    assert len(s.scan("\n".join([notice] * 100_000))) == 100_000
    assert len(s.scan("\n".join(f"Copyright {i} A{i}. {notice}" for i in range(500)))) == 500
    assert len(s.scan(" ".join(f"Copyright {i} A{i}. {notice}" for i in range(500)))) == 500


def brute_best(lines):
    """The wording with the fewest differing words over every range of lines, without compression."""
    words = [re.findall(r"[\w.+-]*\w", line.lower()) for line in lines]
    best = None
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            wanted = re.findall(r"[\w.+-]*\w", wording.lower())
            for a in range(len(lines)):
                for b in range(a + 1, len(lines) + 1):
                    part = [w for line in words[a:b] for w in line]
                    if abs(len(part) - len(wanted)) * 10 <= len(wanted):
                        same = sum(m.size for m in SequenceMatcher(None, part, wanted, autojunk=False).get_matching_blocks())
                        if (len(wanted) - same) * 10 <= len(wanted) and (best is None or (-same, len(part) - same) < best[0]):
                            best = (-same, len(part) - same), name
    return best and best[1]


def test_compression_ranks_as_brute_force():
    s, rng = Scanner(), random.Random(6)
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            words = wording.split()
            for _ in range(len(words) // 40):  # a word lost here and there
                i = rng.randrange(len(words))
                if not re.search(r"[\d-]", words[i]):
                    del words[i]
            lines = [*prose(rng, 2), *wrapped(" ".join(words)), *prose(rng, 3)]
            assert brute_best(lines) == name == s.scan("\n".join(lines))[0][2], wording


def test_given_documents_and_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = re.compile(r"^(Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.|Licensed under CC BY-NC 4\.0\.|This work is licensed under the GNU General Public License, version 3\.)$", re.M)
    want = sorted((r.doc_id, m.start(), m.end()) for r in docs.collect() for m in lines.finditer(r.text))
    assert sorted((r.doc_id, r.start, r.end) for r in license_scan(docs).collect()) == want and want
    assert license_scan(spark.createDataFrame([], DOC_SCHEMA)).count() == 0 == license_scan(odd_docs(spark)).count()
