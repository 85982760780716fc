"""Gzip members put together from the format's description."""

import zlib


def _text(value):
    return value.encode("latin-1") + b"\0"


#: Optional header fields in the order in which they follow each other: the bit of the flags that announces each, and its bytes.
OPTIONAL = {"extra": (2, lambda value: len(value).to_bytes(2, "little") + value), "filename": (3, _text), "comment": (4, _text)}


def member(payload=b"", level=6, mtime=0, **fields):
    """One member; ``fields``: extra, filename, comment, and header_crc (true or false)."""
    present = [(bit, to_bytes(fields[name])) for name, (bit, to_bytes) in OPTIONAL.items() if fields.get(name) is not None]
    checked = bool(fields.get("header_crc"))
    flags = sum(1 << bit for bit, _ in present) + 2 * checked
    header = b"".join([bytes([31, 139, 8, flags]), mtime.to_bytes(4, "little"), bytes([0, 255]), *(data for _, data in present)])
    if checked:
        header += (zlib.crc32(header) % 65536).to_bytes(2, "little")
    trailer = zlib.crc32(payload).to_bytes(4, "little") + (len(payload) % 2**32).to_bytes(4, "little")
    return header + zlib.compress(payload, level, wbits=-15) + trailer


GOOD = member(b"hello world\n" * 100, filename="data.bin")
BODY = 10 + len("data.bin") + 1


def flip(data, at, mask=1):
    at %= len(data)
    return data[:at] + bytes([data[at] ^ mask]) + data[at + 1 :]


CORRUPT = {
    "magic": flip(GOOD, 0, 0x1F),
    "method": flip(GOOD, 2),
    "reserved flags": flip(GOOD, 3, 0x20),
    "extra too long": member(b"x", extra=b"ab")[:10] + b"\xff\xff" + member(b"x", extra=b"ab")[12:],
    "body": GOOD[:BODY] + bytes([(GOOD[BODY] & 0xF8) | 7]) + GOOD[BODY + 1 :],
    "crc": flip(GOOD, -8),
    "size": flip(GOOD, -4),
    "zeroed trailer": GOOD[:-8] + b"\0" * 8,
    "header crc": flip(member(b"abc", header_crc=True), 10),
    "junk": GOOD + b"junk",
    "leading zeros": b"\0" + GOOD,
    "one byte of padding set": GOOD + b"\0\0\1\0",
    **{f"cut at {n}": GOOD[:n] for n in (1, 2, 3, 5, 9, 10, 14, BODY + 2, len(GOOD) - 9, len(GOOD) - 8, len(GOOD) - 1)},
}
