import gzip
import hashlib
import random

from lumidoc.llm import warc


def brute(rows, least=warc.LEAST):
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page_id is not None:
            first[body] = max(first.get(body, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        refers = first.get(body) if len(body) >= least and page_id is not None and first[body] != page_id else None
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def pages():
    rnd = random.Random(6)
    big = ["é<p>" * 300, "x" * 1000, "y" * 999, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40]
    rows = [(k, f"http://h/{k}", rnd.choice(big + ["", "short", "".join(rnd.choice("ab<>é") for _ in range(1500))])) for k in range(60)]
    return rows + [(60, None, None), (61, "http://h/\r\nX: y", big[0]), (62, "ü", "long " * 300_000), (None, "u", big[1])]


def result(df):
    read = warc.round_trip(df).where("kind in ('response', 'revisit')")
    rows = read.select(warc.page_of(read.record_id).alias("p"), "length", "digest", "kind", warc.page_of(read.refers_to).alias("r")).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_round_trip_against_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, id int, digest string")
    assert result(df) == brute(rows)
    again = warc.read(warc.write(warc.decided(df))).where("kind = 'response'").collect()
    assert {bytes(r.payload) for r in again} == {(h or "").encode() for _, _, h in rows}
    assert next(r.url for r in again if r.record_id == "<urn:page:62>") == "ü"
    assert warc.read(warc.write(warc.decided(df))).where("kind = 'gap'").count() == 0


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "u", "z" * 1200), (5, "u", "z" * 1200), (4, "u", "z" * 1200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r[3] for r in result(df)] == ["revisit", "response", "response"]
    assert result(df.limit(0)) == []


def archive(bodies, packed=True):
    parts = []
    for k, b in enumerate(bodies):
        record = warc.page_record(k, f"http://h/{k}", b, hashlib.sha1(b).hexdigest(), None)
        parts.append(warc._member(record) if packed else record)
    return parts


def test_salvage_goes_on_behind_damage():
    bodies = [bytes([65 + k]) * (200 + 37 * k) for k in range(8)]
    for packed in (True, False):
        parts = archive(bodies, packed)
        whole = [x["payload"] for x in warc.salvage(b"".join(parts))]
        assert whole == bodies
        hurt = bytearray(parts[3])
        hurt[-60] ^= 0xFF  # in the block
        junk = b"\x00garbage\x1f\x8b\x08WARC/1.\r\n"
        data = junk + b"".join(parts[:3]) + bytes(hurt) + b"".join(parts[4:6]) + parts[6][:-7] + parts[7]
        found = list(warc.salvage(data))
        assert [x["payload"] for x in found if x["kind"] == "response"] == [bodies[k] for k in (0, 1, 2, 4, 5, 7)]
        gaps = [(x["offset"], x["length"]) for x in found if x["kind"] == "gap"]
        lens = list(map(len, parts))
        assert gaps == [(0, len(junk)), (len(junk) + sum(lens[:3]), lens[3]), (len(junk) + sum(lens[:6]), lens[6] - 7)]
        assert sum(n for _, n in gaps) + sum(lens[k] for k in (0, 1, 2, 4, 5, 7)) == len(data)


def test_salvage_of_odd_archives():
    assert list(warc.salvage(b"")) == []
    assert [x["kind"] for x in warc.salvage(b"nothing at all")] == ["gap"]
    cut = archive([b"a" * 500])[0][:-20]
    assert [x["reason"] for x in warc.salvage(cut)] == ["a member is cut off"]
    several = gzip.compress(b"".join(archive([b"a" * 5, b"b" * 6], packed=False)))
    assert [x["payload"] for x in warc.salvage(several)] == [b"a" * 5, b"b" * 6]
    wrong = archive([b"a" * 50], packed=False)[0].replace(b"a" * 50, b"b" * 50)
    assert [x["reason"] for x in warc.salvage(wrong)] == ["the block's digest doesn't fit"]
    foreign = archive([b"a" * 50], packed=False)[0].replace(b"WARC-Block-Digest: sha1", b"WARC-Block-Digest: md5")
    assert [x["payload"] for x in warc.salvage(foreign)] == [b"a" * 50]
    assert [x["reason"] for x in warc.salvage(foreign.replace(b"a" * 50, b"b" * 50))] == ["the payload's digest doesn't fit"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame(pages()[:20], "page_id long, url string, html string")
    archives = warc.write(warc.decided(df), 2000)
    folder = tmp_path / "archives"
    folder.mkdir()
    warc.save_files(archives, str(folder))
    assert len(list(folder.glob("*.warc.gz"))) > 1
    got = warc.read_files(spark, f"file://{folder}").where("kind in ('response', 'revisit')")
    assert sorted(r.record_id for r in got.collect()) == sorted(f"<urn:page:{k}>" for k in range(20))


def test_records_of_other_writers():
    body = b"<p>x</p>" * 30
    digest = hashlib.sha1(body).hexdigest()
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    def record(kind, block, *more):
        head = "".join(f"{x}\r\n" for x in (f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x:1>", "Content-Type: application/http;msgtype=response", *more, f"Content-Length: {len(block)}"))
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    hexed = record("response", http + body, f"WARC-Payload-Digest: sha1:{digest}", "WARC-Target-URI: http://h/a", "X-Note: one", "\ttwo")
    bare = record("revisit", b"", f"WARC-Payload-Digest: SHA1:{digest.upper()}", "WARC-Refers-To: <urn:x:0>")
    headed = record("revisit", http, f"WARC-Payload-Digest: {warc._sha1(body)}")
    found = list(warc.salvage(hexed + bare + headed))
    assert [(x["kind"], x["digest"], x["length"]) for x in found] == [("response", digest, len(body)), ("revisit", digest, None), ("revisit", digest, None)]
    wrong = hexed.replace(digest.encode(), b"0" * 40)
    assert [x["reason"] for x in warc.salvage(wrong)] == ["the payload's digest doesn't fit"]


def test_salvage_inside_one_member():
    bodies = [bytes([97 + k]) * (3000 + k) for k in range(6)]
    plain = archive(bodies, packed=False)
    hurt = plain[2].replace(bodies[2], b"?" + bodies[2][1:])
    found = list(warc.salvage(gzip.compress(b"".join([*plain[:2], hurt, *plain[3:]]))))
    assert [x["payload"] for x in found if x["kind"] != "gap"] == [bodies[k] for k in (0, 1, 3, 4, 5)]
    gap = [x for x in found if x["kind"] == "gap"]
    assert [(x["inner"], x["length"]) for x in gap] == [(sum(map(len, plain[:2])), len(hurt))]
    import random

    noise = [random.Random(k).randbytes(9000) for k in range(6)]
    member = gzip.compress(b"".join(archive(noise, packed=False)))
    found = list(warc.salvage(member[: len(member) * 2 // 3]))
    kept = [x["payload"] for x in found if x["kind"] != "gap"]
    assert kept == noise[: len(kept)] and len(kept) >= 3 and [x["reason"] for x in found if x["kind"] == "gap"] == ["a member is cut off"]
