import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from taulab.llm.lines import GROUP, SIGNS, LineParams, _byte_pairs, _links, _signs, _sums, cut_lines, deduplicated, distance, line_groups, most_apart, signatures, similar
from taulab.llm.textbatch import chunks

SCHEMA = "doc_id long, text string, n string, kept boolean"


def normal(line):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[0-9]", "0", low)).strip(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", True) for i, t in rows], SCHEMA)


class Groups:
    def __init__(self):
        self.root = {}

    def find(self, x):
        while self.root.setdefault(x, x) != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        x, y = sorted((self.find(a), self.find(b)))
        self.root[y] = x


def lines_of(rows):
    return [((i, k), normal(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if normal(x)]


def expected(lines, linked):
    """(doc_id, line_no, group_lines, kept, first_doc_id, first_line_no) if the texts in linked are linked and equal ones are."""
    groups, of = Groups(), defaultdict(list)
    for key, text in lines:
        of[text].append(key)
    for keys in of.values():
        for k in keys:
            groups.join(keys[0], k)
    for a, b in linked:
        groups.join(of[a][0], of[b][0])
    size = defaultdict(int)
    for key, _ in lines:
        size[groups.find(key)] += 1
    return sorted((*key, size[groups.find(key)], groups.find(key) == key, *groups.find(key)) for key, _ in lines)


BASE = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))
ROWS = [(i, BASE.replace("wordba", f"word{'q' * (i % 5)}") + f"\nshort line {i % 3}\n\nonly here {chr(97 + i) * 4}") for i in range(12)]
ROWS += [(50, None), (51, ""), (52, " ... \n!"), (53, "Short  LINE 7!"), (54, "one two\ntwo one\none\nÜber été"), (55, "long " * 300 + "\n" + "long " * 301)]


def test_all_pairs_of_a_small_table(spark):
    """Blocks of one symbol bring together nearly all pairs, so the groups are those of edit similarity alone."""
    lines = lines_of(ROWS)
    texts = sorted({t for _, t in lines})
    near = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if 100 * edits(a, b) <= 20 * max(len(a), len(b))]
    p = LineParams(word_blocks=(40, 3), byte_blocks=(40, 3), word_apart=256, byte_apart=256)
    got = sorted(map(tuple, line_groups(frame(spark, ROWS), p).collect()))
    assert got == expected(lines, near)
    assert any(r[2] > 4 for r in got) and any(r[2] == 1 for r in got)


def test_recall_against_edit_similarity(spark):
    """Pairs of lines of any length, found without SimHash: by a shared pair of adjacent words and the edit distance."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = lines_of([(r.doc_id, r.text) for r in docs.collect()])
    texts = sorted({t for _, t in lines if len(t) < 3000})
    con = duckdb.connect()
    con.register("t", pa.table({"id": range(len(texts)), "n": texts}))
    near = con.sql("""WITH w AS (SELECT id, string_split(n, ' ') AS w FROM t), g AS (SELECT DISTINCT id, w[i] || ' ' || coalesce(w[i + 1], '') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w)),
      few AS (SELECT g FROM g GROUP BY g HAVING count(*) BETWEEN 2 AND 60), c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM g x JOIN few ON x.g = few.g JOIN g y ON x.g = y.g AND x.id < y.id)
      SELECT a, b FROM c JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE 5 * least(length(x.n), length(y.n)) >= 4 * greatest(length(x.n), length(y.n)) AND 5 * levenshtein(x.n, y.n) <= greatest(length(x.n), length(y.n))""").fetchall()
    first = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_groups(docs).collect()}
    group = {t: first[key] for key, t in lines}
    assert len(first) == len(lines) and len(near) > 200
    together = sum(group[texts[a]] == group[texts[b]] for a, b in near)
    print("recall", together / len(near), len(near))
    assert together >= 0.9 * len(near)
    long = [(a, b) for a, b in near if max(len(texts[a]), len(texts[b])) >= 200]
    middle = [(a, b) for a, b in near if 50 <= max(len(texts[a]), len(texts[b])) < 200]
    for some, share in ((long, 0.95), (middle, 0.85)):
        assert sum(group[texts[a]] == group[texts[b]] for a, b in some) >= share * len(some) > 0
    # every group is a chain of pairs within the edit similarity
    members = defaultdict(set)
    for t, g in group.items():
        members[g].add(t)
    for ts in members.values():
        rest, reached = set(ts), [min(ts)]
        rest.discard(reached[0])
        for x in reached:
            more = {y for y in rest if similar(x, y, 80)}
            rest -= more
            reached += sorted(more)
        assert not rest


def test_distance_and_links(spark):
    r = random.Random(3)
    for _ in range(300):
        x, y = ("".join(r.choice("abß") for _ in range(r.randint(low, 40))) for low in (1, 0))
        assert distance(x, y) == edits(x, y)
        assert most_apart(x.replace("b", " ").split(" "), y.replace("b", " ").split(" "), 10**6) >= edits(x.replace("b", " "), y.replace("b", " "))
    texts = []
    for k in range(60):
        x = [r.choice("abcdefgh ") for _ in range(r.choice((5, 30, 200, 4000)))]
        texts.append("".join(x))
        for _ in range(r.choice((0, 1, 3, len(x) // 6, len(x) // 4))):
            at = r.randrange(len(x))
            x[at : at + r.choice((0, 1))] = r.choice(("", "z", "yz"))
        texts.append("".join(x))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, norm string")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 120, 2)], "a long, b long")
    want = {k for k in range(0, 120, 2) if 100 * distance(*texts[k : k + 2]) <= 20 * max(map(len, texts[k : k + 2]))}
    assert {x.a for x in _links(pairs, nodes, 80).collect()} == want and 0 < len(want) < 60


def test_signatures_are_sums_of_signs():
    rng = np.random.default_rng(0)
    first = np.r_[0, np.cumsum([3, 1, 40, 300, 255, 256, 700, 2])]
    rows = rng.integers(0, 1024, first[-1])
    count, width = 4, 3
    sums = SIGNS + GROUP * count * width
    bits = _signs(sums, 1).view(np.uint8).astype(int) * 2 - 1
    sims, keys = signatures(rows, first, (count, width), 1)
    assert [(i, j) for i, j, _ in _sums(rows, first, sums, 1)][-1][1] == 8
    for k in range(8):
        total = bits[rows[first[k] : first[k + 1]]].sum(axis=0)
        assert np.packbits(total[:SIGNS] > 0).tobytes() == sims[k].tobytes()
        for b in range(count):
            key = 0
            for w in range(width):
                own = total[SIGNS + b * width + w :: count * width]
                best = max(range(GROUP), key=lambda x: (abs(own[x]), 2 * x + (own[x] > 0)))
                key |= (2 * best + int(own[best] > 0)) << 5 * w
            assert keys[k][b] == key + ((b + 64) << 5 * width)


def test_lines_of_a_buffer():
    texts = ["One two\n\n two-ONE 3 \n", None, "", "\nÜber  9\n!", "One two"]
    (_, _, buf, offs), = chunks(pa.array(texts))
    cut = cut_lines(buf, offs)
    assert list(zip(cut.row.tolist(), cut.number.tolist(), cut.size.tolist())) == [(0, 0, 7), (0, 2, 9), (3, 1, 6), (4, 0, 7)]
    same = lambda a, b: (cut.k1[a], cut.k2[a]) == (cut.k1[b], cut.k2[b])
    assert same(0, 3) and not same(0, 1)
    rows, first = _byte_pairs(buf, cut, np.array([0, 3]))
    assert first.tolist() == [0, 6, 12] and rows[:6].tolist() == rows[6:].tolist()


def test_text_without_spaces(spark):
    """Lines of one long word: near ones are found, and unlike ones are hardly compared."""
    r = random.Random(5)
    line = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    rows = []
    for k in range(150):
        x = line(80)
        at = r.randrange(80)
        rows += [(2 * k, x), (2 * k + 1, x[:at] + line(1) + x[at + 1 :])]
    rows += [(1000 + k, line(60)) for k in range(2000)]
    rows += [(5000 + k, "https://example.org/" + "".join(r.choice("abcdefghij") for _ in range(50)) + "x" * k) for k in range(3)]
    first = {x.doc_id: x.first_doc_id for x in line_groups(frame(spark, rows)).collect()}
    assert sum(first[2 * k] == first[2 * k + 1] for k in range(150)) >= 148
    assert all(first[1000 + k] == 1000 + k for k in range(2000))


def test_what_is_linked_does_not_depend_on_other_lines(spark):
    near = lambda x: {k: v for k, v in x.items() if k[0] < 100}
    more = [(1000 + k, " ".join(f"other{chr(97 + (k * j) % 26)}{j}" for j in range(3, 20))) for k in range(3000)]
    runs = [{(x.doc_id, x.line_no): x.first_doc_id for x in line_groups(frame(spark, rows)).collect()} for rows in (ROWS, ROWS + more)]
    assert near(runs[0]) == near(runs[1])


def test_unlike_lines_hardly_meet():
    """28 blocks of five symbols of five bits brought members of these lines together 379 times, 40 of four symbols of seven bits do 97 times."""
    rng, p, n = np.random.default_rng(1), LineParams(), 20000
    rows, first = rng.integers(0, 4096, 12 * n), np.arange(0, 12 * n + 1, 12)
    _, keys = signatures(rows, first, p.word_blocks, 1, p.word_group, p.word_sums)
    assert sum(n - len(np.unique(k)) for k in keys.T) <= 190


def test_a_hot_group_and_a_chain_in_one_bucket(spark):
    """Many near copies, whose ends are far apart, and lines that only share words with them."""
    words = [f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [(k, " ".join(words[k // 2 : k // 2 + 40])) for k in range(160)]
    lines = lines_of(rows)
    texts = sorted({t for _, t in lines})
    near = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if 100 * edits(a, b) <= 20 * max(len(a), len(b))]
    got = sorted(map(tuple, line_groups(frame(spark, rows), LineParams(word_blocks=(30, 4))).collect()))
    assert got == expected(lines, near)


def test_documents_without_their_lines(spark):
    rows = [(1, "First line here.\nSecond one\n\nfirst LINE here"), (2, "first line here\nOwn line"), (None, None), (1, "First line here.\nSecond one\n\nfirst LINE here")]
    out = sorted((r.doc_id or 0, r.text) for r in deduplicated(frame(spark, rows)).collect())
    assert out == [(0, None), (1, "First line here.\nSecond one\n"), (1, "First line here.\nSecond one\n"), (2, "Own line")]
    assert deduplicated(frame(spark, rows)).columns == ["doc_id", "text", "n", "kept"]
    clash = frame(spark, rows).withColumns({x: F.lit(7) for x in ("_gone", "_id", "line_no", "_ID_")})
    got = deduplicated(clash)
    assert got.columns == clash.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == out and all(r._gone == 7 for r in got.collect())


def test_empty_table(spark):
    assert line_groups(frame(spark, ROWS).limit(0)).collect() == []
