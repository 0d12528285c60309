"""The cuckoo filter by itself, index updates, and exact dedup against a dictionary."""

import hashlib
import random

from parlance.llm import exact_dedup as X


def test_filter_never_misses_and_deletes():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    table = X.CuckooFilter(4000)
    assert all(table.insert(k) for k in keys) and all(table.contains(k) for k in keys)
    assert all(table.delete(k) for k in keys[:1500])
    assert all(table.contains(k) for k in keys[1500:])
    assert sum(table.contains(k) for k in keys[:1500]) < 30


def test_part_resizes_and_verifies():
    part = X.DigestPart(capacity=4)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    for i, d in enumerate(digests):
        part.add(d, i, 1)
        part.add(d, i - 1, 2)
    assert part.resized > 3 and len(list(part.entries())) == 2000
    assert all(part.find(d) == [i, 3] for i, d in enumerate(digests))
    twin = digests[0][:8] + digests[1][8:16] + b"x" * 16  # the filter can't tell it from digests[1]
    assert part.filter.contains(X.DigestPart._value(twin)) and part.find(twin) is None
    assert part.remove(digests[1]) and part.find(digests[1]) is None and not part.remove(digests[1])


def test_like_a_dictionary(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a ", "b\n", "é", "long" * 4000, "", None])) for i in range(200)] + [(None, "a"), (None, "only"), (7, "a"), (7, "a")]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, keep_id int").repartition(5)
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    want = []
    for doc_id, text in rows:
        own = groups[text or ""]
        keep = max((i for i in own if i is not None), default=None)
        want.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    for parts in (None, 1, 300):
        got = X.exact_duplicates(docs, parts=parts)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert X.exact_duplicates(docs.limit(0)).count() == 0


def test_insertions_and_deletions(spark):
    digest = lambda *xs: spark.createDataFrame([(bytearray(hashlib.sha256(x.encode()).digest()), i, 1) for i, x in xs], "digest binary, keep_id long, live long")
    first = X.updated_index(None, digest((1, "a"), (2, "b"), (3, "a")), parts=4)
    after = X.updated_index(first, digest((9, "c"), (0, "a")), digest((0, "b")).select("digest"), parts=4)
    got = {bytes(r.digest): (r.keep_id, r.live) for r in after.collect()}
    assert got == {hashlib.sha256(b"a").digest(): (3, 3), hashlib.sha256(b"c").digest(): (9, 1)}
