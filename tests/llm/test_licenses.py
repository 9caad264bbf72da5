"""License scans against Dice coefficients of all units and templates."""

import re
import textwrap

from adjudica.llm import licenses

TEMPLATES = licenses.templates()
GRAMS = [(n, licenses.bigrams(t)) for n, t in TEMPLATES]
MIT = TEMPLATES[0][1]


def brute(text, least=0.8):
    units = {(0, len(text))}
    at = 0
    for m in [*re.finditer(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text), None]:
        end = m.start() if m else len(text)
        units.add((at, end))
        line = at
        for part in text[at:end].split("\n"):
            units.add((line, line + len(part)))
            line += len(part) + 1
        at = m.end() if m else at
    out = []
    for s, e in sorted(units):
        a = licenses.bigrams(text[s:e])
        scores = [(-2 * len(a & b) / (len(a) + len(b)), n) for n, b in GRAMS if a]
        if scores and -min(scores)[0] >= least:
            out.append((s, e, min(scores)[1], -min(scores)[0]))
    return out


def test_scan(spark):
    texts = [None, "", " \n\n ", "Released under the MIT License.", "Some text.\nLicensed under CC BY-NC 4.0.\nMore text.", "Copyright (c) 2020 A B\n\n" + MIT + "\n\nThe end.", MIT.replace(". ", ".\n\n"), "word " * 20000 + "\nThis work is licensed under the GNU General Public License, version 3.\n", "license license", "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "x"), (3, texts[3], "x")], "doc_id long, text string, license string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        expected = brute(text)
        assert [(m.start, m.end, m.license, m.dice) for m in r.matches] == expected
        assert r.n_matches == len(expected) and (r.license is None) == (not expected)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert {r.doc_id: r.license for r in rows if r.doc_id in (3, 4, 5, 7, 9)} == {3: "MIT", 4: "CC-BY-NC-4.0", 5: "MIT", 7: "GPL-3.0", 9: "Apache-2.0"}


def test_licences_of_several_paragraphs_and_notices_within_lines(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and "granted" in t)
    a, b = mit.index("The above copyright notice and"), mit.index("THE SOFTWARE IS")
    parts = ["MIT License", "Copyright (c) 2020 A. Person", mit[12:a].strip(), mit[a:b].strip(), mit[b:]]
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 78)) for p in parts)
    prose = " ".join(f"It was day {i} of week {i * 7}, and nobody{i} had thought of weather{i} for a time." for i in range(60))
    before, after = prose + "\n\n", "\n\n" + "\n".join(f"def main{i}(x):\n    return x.y{i}(1)" for i in range(60))
    line = "All of it is here. Released under the MIT License. More of it is there, as you know it."
    twice = f"{line}\n{prose}\n{line}"
    texts = [before + wrapped + after, line, twice, before + after]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].license for i in range(4)] == ["MIT", "MIT", "MIT", None]
    m = rows[0].matches[0]
    assert rows[0].n_matches == 1 and m.dice > 0.95 and texts[0][m.start : m.end].startswith(("MIT License", "Permission is")) and texts[0][m.start : m.end].endswith("SOFTWARE.")
    assert [line[m.start : m.end] for m in rows[1].matches] == ["Released under the MIT License."] and rows[2].n_matches == 2


def test_whole_texts_of_long_licences(spark):
    names = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    whole = {n: t for n, t in TEMPLATES if len(t) > 5000}
    assert names <= whole.keys()
    prose = "\n\n".join(f"Chapter {i}. The sea was calm on day {i * 3}, and nobody had seen a ship{i} for weeks." for i in range(400))
    texts = {n: t for n, t in whole.items() if n in names}
    rows = [(n, t.replace("  ", " ")) for n, t in texts.items()] + [(n + " within", prose + "\n\n" + t + "\n\n" + prose) for n, t in texts.items() if len(t) < 20_000] + [("none", prose)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()}
    for name, text in rows[:-1]:
        best = max(found[name].matches, key=lambda m: m.end - m.start)
        assert best.license == name.split(" ")[0] and best.dice > 0.9 and best.end - best.start > 0.8 * len(whole[best.license].replace("  ", " ")), (name, best)
    assert found["none"].license is None
