"""op4 against a plain version."""

import hashlib

from lotloom.llm import warc


def test_archives_round_trip(spark):
    big = "<p>é" * 60
    rows = [(3, "http://a", big), (1, "http://b\r\nx", big), (2, None, big), (4, "u", None), (5, "u", ""), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "u", "y" * 100), (9, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", big), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 300_000), (-5, "u", "neg" * 50), (11, "u", "neg" * 50)]
    rows += [(1000 + k, "hot", "same" * 40) for k in range(700)]
    pages = spark.createDataFrame([(*r, "response", 1) for r in rows], "page_id long, url string, html string, record_type string, refers_to int").repartition(5)
    index, folder = warc.archived(pages)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows) == index.count()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i is not None and h in first and first[h] < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.payload is not None for r in got) == sum(w[3] == "response" for w in want)
    one = warc.read_records(index.where("page_id = 10"), folder).collect()
    assert len(one) == 1 and one[0].payload == rows[11][2].encode()
    none, folder = warc.archived(pages.limit(0))
    assert warc.read_records(none, folder).count() == 0


def test_ranges_are_joined():
    assert warc.ranges([("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP, 5), ("a", 21 + 3 * warc.GAP, 1), ("b", 0, warc.READ + 1)]) == [("a", 0, 20 + warc.GAP, [(0, 10), (10, 5), (15 + warc.GAP, 5)]), ("a", 21 + 3 * warc.GAP, 22 + 3 * warc.GAP, [(21 + 3 * warc.GAP, 1)]), ("b", 0, warc.READ + 1, [(0, warc.READ + 1)])]
