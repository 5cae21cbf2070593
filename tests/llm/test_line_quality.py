"""Base counts and line frequencies against plain versions."""

import random
import re
from collections import Counter, defaultdict

from siftstone.llm.line_quality import BASE, base_counts, clean, judge


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_counts():
    rng = random.Random(1)
    texts = [None, "", "\n\n", "a", "a a a a", "x y z x y z", "a\nb\na\n \n \n", "\x1c\x85  é#é", "w " * 5000]
    texts += ["".join(rng.choice("ab #|\n\t") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in texts:
        assert base_counts(t) == plain_counts(t), repr(t)


def norm(line):
    return b" ".join(line.lower().encode().split())


def plain_judge(rows, least, root, left):
    by_host, sizes = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        sizes[host].add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                by_host[host, norm(line)].add(text or "")
    gone = {k for k, v in by_host.items() if len(v) > least and len(v) > root * len(sizes[k[0]]) ** 0.5}
    out = []
    for key, text, host in rows:
        n, *rest = plain_counts(text)
        removed = sum(len(line.encode().split()) for line in (text or "").split("\n") if (host, norm(line)) in gone)
        failed = n < 50 or 100 * rest[3] > 50 * n
        out.append((key, n, *rest, failed, not failed and not n - removed < left * n, removed, "\n".join(x for x in (text or "").split("\n") if (host, norm(x)) not in gone)))
    return out


def test_judge_and_clean(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    common, half = "Common Boiler  plate " + line(10), line(70)
    rows = [(i, "\n".join([common, line(60), line(20)]) if i % 2 else line(80), ("a", "b", None)[i % 3]) for i in range(60)]
    rows += [(100 + i, f"{half}\n{common}\n{line(10)}", "c") for i in range(14)] + [(200 + i, "copy " + line(0) + half, "d") for i in range(20)]
    rows += [(1, rows[1][1], rows[1][2]), (1, "other " + line(60), "a"), (None, line(55), "a"), (7, None, "a"), (8, "", "z"), (9, "no end " * 4000, "z")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lines string")
    want = plain_judge(rows, 5, 1.5, 0.3)
    got = judge(docs, least=5, root=1.5).collect()
    assert Counter((r["key"], *(r[b] for b in BASE), r["base_failed"], r["kept"], r["removed"]) for r in got) == Counter(w[:-1] for w in want)
    assert any(w[-2] for w in want) and not all(w[-3] for w in want)
    kept = clean(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((w[0], w[-1] or None) for w in plain_judge(rows, 10, 1.0, 0.3) if w[-3])
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "lines"}
    assert judge(docs.limit(0)).count() == 0 and clean(docs.limit(0)).count() == 0
