import random

from lumidoc.llm import linededup


def one_edit(a, b):
    """Levenshtein distance of at most 1 between two sequences, by definition."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1] <= 1


def near(a, b, least_chars=0):
    if abs(len(a) - len(b)) < 2 and max(len(a), len(b)) >= least_chars and one_edit(a, b):
        return True
    x, y = a.split(), b.split()
    return max(len(x), len(y)) >= linededup.WORDS and abs(len(x) - len(y)) < 2 and one_edit(x, y)


def brute(docs, least_chars=0):
    first = {}
    order = sorted({(d is not None, d, t) for d, t in docs if t is not None}, key=lambda x: (x[0], x[1] or 0))
    for _, doc, text in order:
        for k, line in enumerate(text.split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                first.setdefault(line.strip(" \t\r\x0b\x0c"), (doc, k))
    names = list(first)
    stay = {}
    for n, line in enumerate(names):
        if not any(near(x, line, least_chars) for x in names[:n]):
            stay[first[line]] = line
    out = {}
    for doc, text in docs:
        if text is None:
            out[doc] = None
            continue
        out[doc] = "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip(" \t\r\x0b\x0c") or stay.get((doc, k)) == x.strip(" \t\r\x0b\x0c"))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in linededup.dedup(df, **more).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abc d") for _ in range(rnd.choice([1, 2, 5, 8, 19, 20, 40, 90]))).strip() or "x" for _ in range(40)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rnd.randint(0, 8)):
            line = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                k = rnd.randrange(len(line) + 1)
                line = rnd.choice([line[:k] + rnd.choice("abcé") + line[k:], line[:k] + line[k + 1 :], line[:k] + rnd.choice("abcé") + line[k + 1 :]])
            lines.append(rnd.choice(["", " ", "\t"]) + line)
            if rnd.random() < 0.1:
                lines.append("")
        rows.append((doc, "\n".join(lines)))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least_chars=12) == brute(rows, 12)


def test_words(spark):
    rnd = random.Random(6)
    base = [[rnd.choice("the a house river stone light und Straße 12 x".split()) for _ in range(rnd.choice([6, 7, 8, 9, 16, 17, 40]))] for _ in range(12)]
    rows = []
    for doc in range(50):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            words = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                k = rnd.randrange(len(words))
                words[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["changed"], ["another"]])
            lines.append(rnd.choice([" ", "  ", " "]).join(words) or "x")
        rows.append((doc, "\n".join(lines)))
    assert run(spark, rows) == brute(rows)


def test_very_long_lines(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(150_000)).strip()
    rows = [(1, text), (2, text[:70_000] + "#" + text[70_001:]), (3, text[:9] + text[10:]), (4, "q" + text[::-1])]
    assert run(spark, rows) == {1: text, 2: "", 3: "", 4: "q" + text[::-1]}


def test_cases(spark):
    long = "the same sentence " * 3000
    rows = [(3, None), (4, ""), (5, long), (6, long + "\n" + long[:-2] + "s"), (7, " \n\n"), (None, "a line that comes first of all"), (1, "a line that comes first of all\nb"), (1, "a line that comes first of all\nb")]
    got = run(spark, rows)
    assert got[3] is None and got[4] == "" and got[5] == long and got[6] == "" and got[7] == " \n\n"
    assert got[None] == "a line that comes first of all" and got[1] == "b"


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(df).count() == 0
    clash = spark.createDataFrame([(1, "x y", 7, "k", 3, 9)], "doc_id long, text string, id int, kept string, n_lines int, h1 int")
    row = linededup.dedup(clash).collect()[0]
    assert (row.id, row.kept, row.h1, row.n_lines, row.n_dropped) == (7, "k", 9, 1, 0)
    names = ["__kept", "__mark", "__id", "__of", "mark", "of", "At", "N_Dropped"]
    clash = spark.createDataFrame([(1, "x y z", *range(8)), (2, "x y z", *range(8))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    rows = {r.doc_id: r for r in linededup.dedup(clash).collect()}
    assert [rows[1][n] for n in names[:7]] == list(range(7)) and rows[1].text == "x y z" and rows[2].text == "" and rows[2].n_dropped == 1
