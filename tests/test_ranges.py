"""Captures in byte ranges: equal to one reader, whatever the range size, the format or the damage."""

import os
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from flowquarry.sources import captures, ranges


def _classic(rng, records, order="<", ticks=10**6, base=1_700_000_000):
    magic = next(m for m, v in ranges.CLASSIC.items() if v == (order, ticks))
    out, rows = [magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)], []
    for i in range(records):
        frame = rng.randbytes(rng.choice([1, 14, 60, 60, 200, 1500]))
        out.append(struct.pack(order + "IIII", base + i, i % 1000, len(frame), len(frame)) + frame)
        rows.append((base + i + i % 1000 / ticks, frame))
    return b"".join(out), rows


def _block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def _blocks(rng, records, order="<"):
    """A section with two interfaces (microseconds; 2^-10 s and an offset), one of them named half way."""
    def face(link, options=b""):
        return _block(order, ranges.INTERFACE, struct.pack(order + "HHI", link, 0, 100) + options)

    option = struct.pack(order + "HHB3x", 9, 1, 0x8A) + struct.pack(order + "HHq", 14, 8, 1000) + struct.pack(order + "HH", 0, 0)
    out, rows = [_block(order, ranges.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)), face(1)], []
    for i in range(records):
        if i == records // 2:
            out.append(face(101, option))
        frame, later = rng.randbytes(rng.randrange(1, 90)), i > records // 2 and i % 2
        stamp = 5_000_000_000 + i
        if i % 7 == 3:
            out.append(_block(order, ranges.SIMPLE_PACKET, struct.pack(order + "I", len(frame)) + frame))
            rows.append((None, 1, frame))
            continue
        head = struct.pack(order + "II", stamp >> 32, stamp & 0xFFFFFFFF) + struct.pack(order + "II", len(frame), len(frame))
        if i % 7 == 5:
            out.append(_block(order, ranges.OLD_PACKET, struct.pack(order + "HH", int(later), 0) + head + frame))
        else:
            out.append(_block(order, ranges.PACKET, struct.pack(order + "I", int(later)) + head + frame))
        out.append(_block(order, 4, b"names") if i % 50 == 0 else b"")
        rows.append((1000 + stamp / 1024, 101, frame) if later else (stamp / 1e6, 1, frame))
    return b"".join(out), rows


def _read(spark, contents, size):
    folder = tempfile.mkdtemp(prefix="captures-")
    for name, content in contents.items():
        with open(os.path.join(folder, name), "wb") as out:
            out.write(content)
    files = ranges.capture_files(spark, folder)
    plan = ranges.plan_ranges(files, size)
    rows = ranges.read_ranges(plan, files).withColumn("name", F.substring_index("path", "/", -1)).orderBy("file", "pos").collect()
    found = {n: [r for r in rows if r["name"] == n] for n in contents}
    assert all([r["pos"] for r in f] == list(range(len(f))) for f in found.values())
    errors = {r["path"].rsplit("/", 1)[1]: (r["pos"], r["error"]) for r in plan.filter(F.col("error").isNotNull()).collect()}
    return found, errors, folder


@pytest.mark.parametrize("size", [700, 1 << 27])
def test_all_formats(spark, size):
    rng = random.Random(size)
    made = {f"{k}.pcap": _classic(rng, 150, *v) for k, v in enumerate(ranges.CLASSIC.values())}
    blocks = {"5.ng": _blocks(rng, 150, "<"), "6.ng": _blocks(rng, 150, ">")}
    joined = blocks["5.ng"], blocks["6.ng"]
    blocks["7.ng"] = joined[0][0] + joined[1][0], joined[0][1] + joined[1][1]  # sections of both byte orders
    found, errors, _ = _read(spark, {n: c for n, (c, _) in (made | blocks).items()}, size)
    assert errors == {}
    for name, (_, rows) in made.items():
        assert [(r["t"], bytes(r["frame"])) for r in found[name]] == [(pytest.approx(t), f) for t, f in rows]
    for name, (_, rows) in blocks.items():
        got = [(r["t"], r["link_type"], bytes(r["frame"])) for r in found[name]]
        assert got == [(t if t is None else pytest.approx(t), k, f) for t, k, f in rows]


def test_captures_inside_captures(spark):
    """Frames that hold whole captures lead every guess astray; the fold finds it out."""
    inner, rows = _classic(random.Random(1), 40)
    out = [inner[:24]]
    for _ in range(12):
        out.append(struct.pack("<IIII", 1, 1, len(inner), len(inner)) + inner)
    huge = bytes(300_000)  # longer than any guess allows
    out.append(struct.pack("<IIII", 1, 1, len(huge), len(huge)) + huge)
    out.append(inner[24:])
    found, errors, _ = _read(spark, {"a.pcap": b"".join(out)}, 1 << 14)
    got = [bytes(r["frame"]) for r in found["a.pcap"]]
    assert got == [inner] * 12 + [huge] + [f for _, f in rows] and errors == {}


def test_damage_is_what_one_reader_says(spark):
    content, _ = _classic(random.Random(2), 200)
    broken = bytearray(content)
    broken[9000:9400] = b"\xff" * 400
    cases = {"a.pcap": content[:-3], "b.pcap": bytes(broken), "c.pcap": b"", "d.pcap": b"not a capture, but long enough to be one",
             "e.pcap": content[:24], "f.pcap": content + b"123", "g.pcap": content}
    found, errors, folder = _read(spark, cases, 1 << 12)
    whole = captures.split_captures(spark.read.format("binaryFile").load(folder)).collect()
    plain = {n: [r for r in whole if r["path"].endswith(n)] for n in cases}
    for name, rows in plain.items():
        assert [bytes(r["frame"]) for r in found[name]] == [bytes(r["frame"]) for r in sorted(rows, key=lambda r: r["pos"]) if r["error"] is None]
        wrong = [(r["pos"], r["error"]) for r in rows if r["error"]]
        assert [errors[name]] == wrong if wrong else name not in errors
    both = [captures.read_captures(spark, folder, 1 << 12, whole) for whole in (False, True)]
    assert both[0][0].exceptAll(both[1][0]).count() == both[1][0].exceptAll(both[0][0]).count() == 0
    assert sorted(both[0][1].collect()) == sorted(both[1][1].collect())


def test_pcapng_damage(spark):
    content, rows = _blocks(random.Random(3), 60)
    lengths = bytearray(content)
    lengths[-4:] = b"\0\0\0\1"
    found, errors, _ = _read(spark, {"a.ng": content[:-2], "b.ng": bytes(lengths)}, 512)
    assert len(found["a.ng"]) == len(found["b.ng"]) == 59
    assert errors == {"a.ng": (59, "block cut off"), "b.ng": (59, "block lengths differ")}
