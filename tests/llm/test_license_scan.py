import re
from collections import Counter

from newsgrid.llm import license_scan as L
from tests.conftest import SMALL

LINE_OF = dict((n, t) for n, t in reversed(L.TEMPLATES))
BODY = {n: max((t for m, t in L.TEMPLATES if m == n), key=len) for n, _ in L.TEMPLATES}


def dice(a, template):
    b = L.words(template)
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x else 0


def by_hand(text):
    """Every run of lines and every stretch of a template's length against every template, without bounds."""
    lines = [w for w in (L.words(x) for x in re.split("[\\r\\n]", text or "")) if w]
    flat = [w for line in lines for w in line]
    runs = [[w for line in lines[i:j] for w in line] for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
    best, names = (0, 0), set()
    for i, (name, template) in enumerate(L.TEMPLATES):
        m = len(L.words(template))
        top = max((dice(u, template) for u in runs + [flat[k : k + m] for k in range(len(flat) - m + 1)]), default=0)
        if top >= L.THRESHOLD:
            best, names = max(best, (top, -i)), names | {name}
    return (L.TEMPLATES[-best[1]][0], round(best[0], 9), sorted(names)) if names else (None, None, [])


def test_against_hand(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").filter("length(text) < 600 AND doc_id % 4 = 0")
    mit = BODY["MIT"]
    texts = [mit, "Intro\n\n" + mit.replace(" copies", " of the copies").replace(", ", ",\n") + "\n\nMore", "// Licensed under  the apache license version 2.0!", "Licensed under the moon.", mit[:300], None, "a b", "one line, Licensed under CC BY 4.0. and more\r\nLicensed\runder the\r\nMIT license"]
    extra = spark.createDataFrame(list(zip(range(-1, -20, -1), texts)), "doc_id long, text string")
    rows = docs.union(extra).union(odd.select("doc_id", "text").filter("length(text) < 3000 OR text IS NULL"))
    got = L.op3_license(rows).collect()
    assert Counter((r.doc_id, r.license, r.dice, tuple(r.licenses)) for r in got) == Counter((r.doc_id, n, v, tuple(a)) for r in rows.collect() for n, v, a in [by_hand(r.text)])
    named = {r.doc_id: r.license for r in got}
    assert [named[i] for i in range(-1, -9, -1)] == ["MIT", "MIT", "Apache-2.0", None, None, None, None, "MIT"]
    assert L.op3_license(none).count() == 0 and L.op3_license(odd).count() == odd.count()


FILLER = "The river rose in the night and the council met at noon to hear from the people of the town. " * 40


def published(name):
    """A licence as it is printed: wrapped at 70 signs, with empty lines between its parts."""
    text = re.sub(r" (THE SOFTWARE IS|THIS SOFTWARE IS|The above copyright|1\\. |2\\. |3\\. |You may obtain|Unless required|This program is distributed|You should have|In jurisdictions|Anyone is free)", r"\n\n\1", BODY[name])
    return "\n\n".join("\n".join(re.findall(r"\S(?:.{0,68}\S)?(?=\s|$)", part)) for part in text.split("\n\n"))


def test_published_layout_inside_documents(spark):
    """Each template in paragraphs, in the middle of a long text, in comments of several kinds, with CR LF, and in one line."""
    rows, want = [], {}
    for i, name in enumerate(sorted(BODY)):
        text = published(name)
        marked = lambda mark: "\n".join(f"{mark} {x}" for x in text.split("\n"))  # noqa: E731, B023
        forms = [FILLER + "\n\n" + text + "\n\n" + FILLER, "/*\n" + marked(" *") + "\n */\nint main;\n" + FILLER, FILLER + "\n" + marked("#") + "\n" + FILLER, (FILLER + "\n\n" + text + "\n\n").replace("\n", "\r\n"), FILLER + " " + BODY[name] + " " + FILLER]
        for k, t in enumerate(forms):
            rows.append((10 * i + k, t))
            want[10 * i + k] = name
    rows.append((9999, FILLER * 10))
    got = {r.doc_id: (r.license, r.licenses) for r in L.op3_license(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9999] == (None, [])
    assert all(want[d] in got[d][1] for d in want), [d for d in want if want[d] not in got[d][1]]
