"""op10 and op2 against plain versions."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from lotloom.llm import license_scan, media, scratch

ODD = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 200_000), (5, "x"), (5, "x"), (None, "MIT License"), (8, "\x00\n\t end")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", t) for i, t in rows], "doc_id long, text string, feature string, media string")


def test_media_round_trip(spark):
    got = {(r.doc_id, r.n_bytes): r for r in media.text_features(frame(spark, ODD)).collect()}
    assert len(got) == 7
    for i, text in ODD:
        raw = (text or "").encode()
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.text_picture(text)).hexdigest()
        tile = np.load(io.BytesIO(scratch_bytes(r.tile_file)))[r.tile_row]
        assert (tile == media.area_resized(np.frombuffer(padded, np.uint8).reshape(-1, 64))).all() and media.difference_hash(tile) == r.feature
    assert media.text_features(frame(spark, [])).count() == 0


def scratch_bytes(name):
    """The file of that name among the folders that are kept."""
    for _, folder in scratch._KEPT:
        fs, root = scratch.filesystem(folder)
        if fs.get_file_info(f"{root}/{name}").type.name == "File":
            with fs.open_input_file(f"{root}/{name}") as f:
                return f.read()
    raise FileNotFoundError(name)


def test_pictures_of_both_kinds_in_a_table(spark):
    rng = np.random.default_rng(4)
    shapes = [(5, 7), (1, 1), (6, 3, 3), (40, 33)]
    pictures = [rng.integers(0, 256, s).astype(np.uint8) for s in shapes]
    rows = [(k, f(a), "x") for a in pictures for k, f in enumerate((media.netpbm_encoded, media.bmp_encoded))] + [(9, None, "x"), (9, b"GIF89a", "x"), (None, media.bmp_encoded(pictures[0]), "x")]
    table = spark.createDataFrame(rows, "id long, media binary, feature string").repartition(2)
    folder = scratch.new_folder(spark, "tiles")
    got = media.described(table, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.media in (None, b"GIF89a"):
            assert (r.payload, r.tile_file, r.tile_row, r.feature) == (None, None, None, None)
        else:
            samples = media.decoded(bytes(r.media))
            tile = np.load(io.BytesIO(scratch_bytes(r.tile_file)))[r.tile_row]
            assert bytes(r.payload) == samples.tobytes() and (tile == media.area_resized(samples)).all() and r.feature == media.difference_hash(tile)
    assert media.described(table.limit(0), folder).count() == 0


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (6, 3, 3), (9, 16)])
def test_pictures_decode(shape):
    a = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decoded(media.netpbm_encoded(a)) == a).all()
    assert (media.decoded(media.bmp_encoded(a)) == a).all()
    assert (media.decoded(b"P2 # c\n2 1\n15\n0 15") == [[0, 255]]).all()
    assert (media.decoded(b"P1 2 1 1 0") == [[0, 255]]).all()
    for bad in (b"", b"P5\n9 9\n255\nab", b"BM", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decoded(bad)


def test_area_resize_equals_means():
    a = np.random.default_rng(2).integers(0, 256, (16, 18)).astype(np.uint8)
    assert (media.area_resized(a) == np.rint(a.reshape(8, 2, 9, 2).mean((1, 3)))).all()
    odd = media.area_resized(a[:5, :4].copy(), 3, 2)
    fine = np.repeat(np.repeat(a[:5, :4], 2, 0), 3, 1).reshape(2, 5, 3, 4).mean((1, 3))
    assert np.abs(odd - fine).max() <= 0.5001


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, at) for k in license_scan.BASE for at in range(len(words)) if words[at : at + len(k.split())] == k.split()]
    starts = [at for _, at in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({license_scan.BASE[k] for k, _ in found}))


def test_license_base_is_brute_force(spark):
    rng = random.Random(3)
    pool = "gnu general public license apache mit cc by the MIT-License, É version 3 copy".split() + ["gnu general public license", "x1"]
    rows = ODD + [(100 + k, rng.choice(["", "\n "]) + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(900, "\n\n".join([license_scan.TEMPLATES["mit-text"], "blah", license_scan.TEMPLATES["gpl-notice"]]).upper()), (901, "licensed under the Apache License Version 2.0")]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got}
    for i, text in rows:
        assert (i, *plain(text)) in by
    labels = {r.doc_id: r for r in got}
    assert {"mit-text", "gpl-notice", "gpl"} <= set(labels[900].labels.split(",")) and labels[901].labels == "apache,apache-line"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.license_scan(frame(spark, [])).count() == 0
