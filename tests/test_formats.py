"""The binary importer, against bytes written here from the formats' description."""

import struct

import pytest

from keyloom.model import Corruption
from keyloom.sources import formats
from keyloom.sources.formats import checksum


def record(payload):
    return struct.pack("<II", len(payload), checksum(payload)) + payload


def change(kind, seq, key, value=b""):
    return record(struct.pack("<BQII", kind, seq, len(key), len(value)) + key + value)


def add(number, low, high, level=None):
    head = struct.pack("<BQ", 1, number) if level is None else struct.pack("<BQI", 3, number, level)
    return record(head + struct.pack("<QQII", 1, 10, len(low), len(high)) + low + high)


def plain(entries):
    return b"".join(struct.pack("<BII", t, len(k), len(v)) + k + v for k, t, v in entries)


def compressed(entries, every=16):
    out, restarts, before = b"", [], b""
    for i, (k, t, v) in enumerate(entries):
        shared = 0
        if i % every:
            while shared < min(len(k), len(before)) and k[shared] == before[shared]:
                shared += 1
        else:
            restarts.append(len(out))
        out += struct.pack("<IIIB", shared, len(k) - shared, len(v), t) + k[shared:] + v
        before = k
    return out + struct.pack(f"<{len(restarts)}I", *restarts) + struct.pack("<I", len(restarts))


def sst(entries, version, per_block=3):
    if version == 1:
        block = plain(entries)
        return block + struct.pack("<QQI", len(entries), len(block), checksum(block)) + b"STKV0001"
    data, index = b"", b""
    for i in range(0, len(entries), per_block):
        own = entries[i : i + per_block]
        raw = plain(own) if version == 2 else compressed(own)
        raw += struct.pack("<I", checksum(raw))
        index += struct.pack("<I", len(own[-1][0])) + own[-1][0] + struct.pack("<QQQ", len(data), len(raw), len(own))
        data += raw
    foot = struct.pack("<QQQI", len(entries), len(data), len(index), checksum(index))
    if version == 4:
        filt = struct.pack("<IIQ", 1, 7, 64) + bytes(8)
        foot += struct.pack("<QQI", len(data) + len(index), len(filt), checksum(filt))
        return data + index + filt + foot + b"STKV0004"
    return data + index + foot + b"STKV000%d" % version


ENTRIES = [(b"alpha", 1, b"one"), (b"alpine", 1, b"two"), (b"alps", 2, b""), (b"beta", 1, b""), (b"tenant/1", 1, b"x"), (b"tenant/2", 1, b"y")]


def test_log_and_torn_tail():
    data = change(1, 1, b"alpha", b"one") + change(2, 2, b"beta")
    want = [{"key": b"alpha", "seq": 1, "type": 1, "value": b"one"}, {"key": b"beta", "seq": 2, "type": 2, "value": b""}]
    assert list(formats.log_changes(data)) == want
    assert list(formats.log_changes(data + b"abc")) == want and list(formats.log_changes(data[:-2])) == want[:1]
    with pytest.raises(Corruption):
        list(formats.log_changes(data[:-1] + b"\xff"))
    with pytest.raises(Corruption):
        list(formats.log_changes(struct.pack("<II", 1024, 0), most=128))


def test_manifest():
    data = add(1, b"a", b"c") + add(7, b"d", b"f", level=2) + record(struct.pack("<BQ", 2, 1))
    assert [(e["op"], e["file_number"], e["level"]) for e in formats.manifest_edits(data)] == [("add", 1, 0), ("add", 7, 2), ("delete", 1, 0)]
    with pytest.raises(Corruption):
        list(formats.manifest_edits(data[:-1]))


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_tables(version):
    data = sst(ENTRIES, version)
    assert [(e["key"], e["type"], e["value"]) for e in formats.table_entries(data)] == ENTRIES
    with pytest.raises(Corruption):
        formats.table_entries(bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(Corruption):
        formats.table_entries(sst(ENTRIES[::-1], version))
    for size in range(len(data) - 8):  # a short file, whatever ends it
        with pytest.raises(Corruption):
            formats.table_entries(data[:size] + data[-8:])


def test_read_binary(spark, tmp_path):
    (tmp_path / "a.sst").write_bytes(sst(ENTRIES, 4))
    (tmp_path / "b.sst").write_bytes(sst(ENTRIES[:2], 1))
    rows = formats.read_binary(spark, str(tmp_path), "table").collect()
    assert len(rows) == 8 and sum(r["type"] == 2 for r in rows) == 1
