"""Cases that a review found."""

import random
import re

import duckdb
import pandas as pd
from test_queries import rows as plain_rows

from lumidoc.operators import chunks as CH
from lumidoc.operators import reading as RD
from lumidoc.plans.all_queries import ORACLES, QUERIES


#: Lines of the input tables where a value is at the gate but for the last bit.
TIES = {(8000 + k, x): v for k, line in enumerate([{21: 0.9, 8: 1.8, 54: 2.5, 22: 0.9, 38: 3.9, 33: 3.8, 36: 3.7}, {16: 3.4, 32: 0.1, 3: 1.6, 10: 3.2, 51: 4.4, 43: 0.6}]) for x, v in line.items()}


def lineitem_of(values):
    """A lineitem table whose column profile is values {(line, x): v}."""
    return pd.DataFrame([(line, x, 1, 1, v * 10.0) for (line, x), v in values.items()], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])


def test_trimmed_columns_rounds_its_base_as_the_sql_does(spark, tmp_path):
    rnd = random.Random(3)
    table = lineitem_of({(line, x): rnd.randint(1, 50) / 10 for line in range(6000) for x in rnd.sample(range(60), rnd.randint(1, 9))} | TIES)
    table.to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert plain_rows(QUERIES["trimmed_columns"](spark, str(tmp_path)).toPandas()) == plain_rows(con.sql(ORACLES["trimmed_columns"]).df())


def test_quantile_has_all_bits_of_the_sql(spark):
    rnd = random.Random(8)
    values = pd.DataFrame([(k, rnd.choice([rnd.randint(1, 50) / 10, rnd.random() * 1e6, -rnd.random()])) for k in range(3000) for _ in range(rnd.randint(1, 30))], columns=["k", "v"])
    want = dict(duckdb.sql("SELECT k, quantile_cont(v, 0.12) FROM values GROUP BY 1").fetchall())
    assert dict(spark.createDataFrame(values).groupBy("k").agg(RD.quantile("v", 0.12)).collect()) == want
    odd = spark.createDataFrame([(1, None), (2, 5.0), (2, None)], "k int, v double").groupBy("k").agg(RD.quantile("v", 0.12))
    assert dict(odd.collect()) == {1: None, 2: 5.0}


def test_label_pairs_keep_runs_of_digits(spark, tmp_path):
    orders = pd.DataFrame([(k, c, "OFP"[k % 3], 1.0, "1-URGENT") for k, c in enumerate([7, 11111, 500000, 1000001, 66666, 9999999])], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    orders.to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    for name in ("label_pairs", "confirmed_chunks"):
        got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLES[name]).df()
        assert plain_rows(got) == plain_rows(want) and any("client 500000" in v for v in got["value"])


def test_pooled_grid_has_the_sign_of_small_means(spark, tmp_path):
    vecs = [[-1e-7, 1e-7, 0.0, -0.25, -0.0000005, 0.0000015] for _ in range(40)]
    pd.DataFrame({"vec_id": range(40), "embedding": vecs, "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = QUERIES["pooled_grid"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["pooled_grid"]).df()
    assert plain_rows(got) == plain_rows(want) and "'-0'" in str(plain_rows(want))


def test_pooled_grid_rounds_ties_as_the_sql_does(spark, tmp_path):
    rnd = random.Random(5)
    vecs = [[rnd.randint(-32, 32) / 32 for _ in range(64)] for _ in range(1000)]  # means of 20 are multiples of 1/640, many between two sixth digits
    pd.DataFrame({"vec_id": range(1000), "embedding": vecs, "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = QUERIES["pooled_grid"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["pooled_grid"]).df()
    assert plain_rows(got) == plain_rows(want) and "0.064062'" in str(plain_rows(want))


def test_confirmed_chunks_shuffles_nothing_and_keeps_equal_keys_apart(spark, tmp_path):
    orders = pd.DataFrame([(k // 2, 100 + k, "OFP"[k % 3], 1.0, "1-URGENT") for k in range(30)], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    orders.to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    found = QUERIES["confirmed_chunks"](spark, str(tmp_path))
    assert plain_rows(found.toPandas()) == plain_rows(con.sql(ORACLES["confirmed_chunks"]).df())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Window", "Sort"))


BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def chunks_of(text, bank):
    """Pairs and their places as the definition has them, line by line and word by word."""

    def is_label(v):
        t = v.strip(BLANK).strip(":： ")
        upper = re.fullmatch(r"[A-Z][A-Z0-9 /&().\-]{2,48}", t) and not re.search("[0-9]", t)
        return not t or len(re.findall(r"(?a:\S+)", t)) <= 6 and bool(upper or re.sub(r"[\W_]", "", t.lower()) in bank)

    lines = [s for s in text.split("\n") if s]
    shape, pairs, used = re.compile("[0-9]|[A-Za-z]{2,}"), [], set()
    for k, s in enumerate(lines):
        m = re.match(r"([^\W\d_][\w /&().\-]{1,48}?)(?a:\s*[:：]\s*)(.+)$", s)
        if m and shape.search(value := m[2].strip(BLANK)) and not is_label(value):
            pairs.append((k, m[1].strip(BLANK), value, "inline"))
            used.add(k)
    for k in range(len(lines) - 1):
        if not {k, k + 1} & used and is_label(lines[k]) and not is_label(lines[k + 1]) and shape.search(lines[k + 1]):
            pairs.append((k, lines[k], lines[k + 1], "stacked"))
            used |= {k, k + 1}
    words = []
    for w in re.findall(r"[\wÀ-ɏͰ-῿Ⰰ-퟿豈-﷏ﷰ-�]+", text):
        cut = re.search("[가-힣一-龥]", w) and len(w) > 4
        words += [x.lower() for x in ([w[i : i + 2] for i in range(0, len(w), 2)] if cut else [w])]
    out, cursor = [], 0
    for _, label, value, _ in pairs:
        tokens = re.findall(r"(?a:\S+)", value.lower())
        spots = [i for i in range(len(words) - len(tokens) + 1) if tokens and words[i : i + len(tokens)] == tokens]
        if spots:
            at = next((i for i in spots if i >= cursor), spots[0])
            out.append((label, value, at, cursor := at + len(tokens)))
    return pairs, out


def test_label_pairs_and_confirmed_chunks_against_their_definition(spark):
    rnd = random.Random(4)
    parts = ["SHIP TO", "PORT OF LOADING", "Remarks", "Größe", "total amount", "A B C D E F G", "12", "12", "ab", "ab 12", "x", "Busan 7", "GROSS:", "заказ", "가나다라마바", "가나", "單價", "INV-7", " ", "\t", "　", ":", ": ", "：", "\n", "\n", "\n", "(", "_", "É1"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "\n", ": "]) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + ["", "\n\n", "Note: a b\nREF\na b\nNote: a b"]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    for bank in (None, ["Remarks", "total amount", "Größe"]):
        known = {re.sub(r"[\W_]", "", b.lower()) for b in bank or []}
        want = [chunks_of(t, known) for t in texts]
        got = CH.label_pairs(docs, "id", "text", bank, clean=False).collect()
        assert sorted(map(tuple, got)) == sorted((k, *p) for k, (pairs, _) in enumerate(want) for p in pairs)
        got = CH.confirmed_chunks(docs, "id", "text", bank, clean=False).collect()
        assert sorted(map(tuple, got)) == sorted((k, *c) for k, (_, out) in enumerate(want) for c in out) and len(got) > 400
