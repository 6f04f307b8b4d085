"""Binary patch formats: parsers of one patch into records, and encoders of records.

Layouts follow the published descriptions of IPS, IPS32, UPS, BPS, PPF and VCDIFF (RFC 3284); APS is the flat form
of records (u32 offset, u8 length, bytes).  Every fault raises ValueError.  Where records go, and where they come
from, is the work of DataFrames in operators/patches.py.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: What patches begin with.
MAGIC = {"ips": b"PATCH", "ips32": b"IPS32", "ups": b"UPS1", "bps": b"BPS1", "aps": b"APS1", "ppf": b"PPF", "vcdiff": b"\xd6\xc3\xc4"}
#: Most bytes of a record, and equal bytes that two changes may have between them to be one record.
MOST = {"ips": 0xFFFE, "ips32": 0xFFFE, "aps": 255, "ppf": 255, "ups": 1 << 40, "bps": 1 << 40, "vcdiff": 1 << 40}
GAP = {"ips": 5, "ips32": 5, "aps": 5, "ppf": 8, "ups": 0, "bps": 3, "vcdiff": 8}


@dataclass
class Patch:
    """Records (offset, bytes), and what the patch says of the objects; ``xor``: bytes are differences.

    ``copies`` (offset, size, place in the source) are records whose bytes are the source's.  A patch that copies
    builds its target anew; what is neither recorded nor copied is zero.
    """

    records: list[tuple[int, bytes]] = field(default_factory=list)
    copies: list[tuple[int, int, int]] | None = None
    xor: bool = False
    grows: bool = True
    source_size: int | None = None
    target_size: int | None = None
    source_crc: int | None = None
    target_crc: int | None = None
    check_at: int | None = None
    check: bytes | None = None


def need(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(what)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the last marked, each further group counting from one more; and what follows it."""
    value, scale = 0, 1
    while True:
        need(at < len(data), "truncated number")
        x = data[at]
        at += 1
        value += (x & 127) * scale
        if x & 128:
            return value, at
        scale <<= 7
        value += scale


def to_varint(value: int) -> bytes:
    out = bytearray()
    while True:
        low, value = value & 127, value >> 7
        if not value:
            return bytes(out) + bytes([low | 128])
        out.append(low)
        value -= 1


def changed_runs(a: bytes, b: bytes, gap: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``b`` that differ from ``a`` (what is beyond ``a`` differs), those with up to ``gap`` equal bytes between them as one, cut to ``most``."""
    y = np.frombuffer(b, np.uint8)
    x = np.frombuffer(a[: len(b)], np.uint8)
    at = np.flatnonzero(np.append(x != y[: len(x)], np.ones(len(y) - len(x), bool)))
    if not len(at):
        return
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    for lo, hi in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist()):
        for start in range(lo, hi + 1, most):
            yield start, min(start + most, hi + 1)


def differences(kind: str, offset: int, a: bytes, b: bytes) -> Iterator[tuple[int, bytes]]:
    """Records that turn a block at ``offset`` into another one; differences for a format of such."""
    if kind == "ups":
        n = max(len(a), len(b))
        b = (np.frombuffer(a.ljust(n, b"\0"), np.uint8) ^ np.frombuffer(b.ljust(n, b"\0"), np.uint8)).tobytes()
        a = bytes(n)
    for lo, hi in changed_runs(a, b, GAP[kind], MOST[kind]):
        if kind in _ENDS and (offset + lo).to_bytes(8)[-_WIDTHS[kind] :] == _ENDS[kind] and lo:
            lo -= 1  # an offset that spells the end mark: begin a byte earlier
        yield offset + lo, b[lo:hi]


def laid(block: bytes, room: int, pieces: Iterable[tuple[int, bytes]], xor: bool) -> bytes:
    """``room`` bytes: a block, zeros after it, and pieces (place in the block, bytes or differences) over it in order."""
    out = bytearray(block[:room].ljust(room, b"\0"))
    for at, data in pieces:
        if data := data[: max(0, room - at)]:
            out[at : at + len(data)] = (np.frombuffer(out, np.uint8, len(data), at) ^ np.frombuffer(data, np.uint8)).tobytes() if xor else data
    return bytes(out)


_ENDS, _WIDTHS = {"ips": b"EOF", "ips32": b"EEOF"}, {"ips": 3, "ips32": 4}


def parsed(patch: bytes, kind: str) -> Patch:
    return {"ips": _ips, "ips32": _ips, "ups": _ups, "aps": _aps, "ppf": _ppf, "bps": _bps, "vcdiff": _vcdiff}[kind](patch, kind)


def _ips(patch: bytes, kind: str) -> Patch:
    size, end, at, out = _WIDTHS[kind], _ENDS[kind], 5, Patch()
    need(len(patch) >= 8, "truncated record")
    while True:
        need(at + size <= len(patch), "truncated record")
        if patch[at : at + size] == end:
            return out
        offset, at = int.from_bytes(patch[at : at + size]), at + size
        need(at + 2 <= len(patch), "truncated record")
        n, at = int.from_bytes(patch[at : at + 2]), at + 2
        width = n or 3  # no length: a run of one byte
        need(at + width <= len(patch), "truncated record")
        out.records.append((offset, patch[at : at + n] if n else patch[at + 2 : at + 3] * int.from_bytes(patch[at : at + 2])))
        at += width


def _aps(patch: bytes, kind: str) -> Patch:
    at, out = 4, Patch(grows=False)
    while at < len(patch):
        need(at + 5 <= len(patch) and at + 5 + patch[at + 4] <= len(patch), "truncated record")
        n = patch[at + 4]
        out.records.append((int.from_bytes(patch[at : at + 4], "little"), patch[at + 5 : at + 5 + n]))
        at += 5 + n
    return out


def _ppf(patch: bytes, kind: str) -> Patch:
    need(len(patch) >= 56, "truncated header")
    version, out = patch[5] + 1, Patch(grows=False)
    need(version in (1, 2, 3), "unknown version")
    need(len(patch) >= (56 if version == 1 else 60), "truncated header")
    at, width, undo = (56 if version == 1 else 60), (8 if version == 3 else 4), version == 3 and patch[58] == 1
    if version == 2:
        out.source_size = int.from_bytes(patch[56:60], "little")
    if version == 2 or version == 3 and patch[57] == 1:
        out.check_at, out.check = (0x80A0 if version == 3 and patch[56] == 1 else 0x9320), patch[at : at + 1024]
        need(len(out.check) == 1024, "truncated block check")
        at += 1024
    tail = patch.find(b"@BEGIN_FILE_ID.DIZ", at)
    end = tail if tail >= 0 else len(patch)
    while at < end:
        need(at + width + 1 <= end, "truncated record")
        offset, n = int.from_bytes(patch[at : at + width], "little"), patch[at + width]
        at += width + 1
        need(at + n * (1 + undo) <= end, "truncated record")
        out.records.append((offset, patch[at : at + n]))
        at += n * (1 + undo)
    return out


def _ups(patch: bytes, kind: str) -> Patch:
    need(len(patch) >= 18 and _crc(patch[:-4]) == patch[-4:], "patch checksum")
    n, at = varint(patch, 4)
    m, at = varint(patch, at)
    out = Patch(xor=True, source_size=n, target_size=m, source_crc=int.from_bytes(patch[-12:-8], "little"), target_crc=int.from_bytes(patch[-8:-4], "little"))
    place = 0
    while at < len(patch) - 12:
        skip, at = varint(patch, at)
        end = patch.find(b"\0", at)
        need(end >= 0, "truncated record")
        place += skip
        if body := patch[at : min(end, at + max(0, m - place))]:
            out.records.append((place, body))
        place, at = place + end - at + 1, end + 1
    return out


class Target:
    """What a target is made of, piece by piece: bytes of the patch, or ranges of the source.

    A copy of what has been written is resolved to the pieces that it copies, so no byte of the source is needed.
    """

    def __init__(self):
        self.size, self.starts, self.pieces = 0, [], []

    def add(self, data: bytes | None, n: int, place: int = 0) -> None:
        """``n`` bytes: of ``data``, or of the source from ``place`` on."""
        if n:
            self.starts.append(self.size)
            self.pieces.append((data, n, place))
            self.size += n

    def again(self, at: int, n: int) -> None:
        """``n`` bytes of the target from ``at`` on, which may be what is written by this."""
        need(0 <= at < self.size, "outside the target")
        period = self.size - at
        if n > period and period < 64 and all(p[0] is not None for p in self.pieces[bisect_right(self.starts, at) - 1 :]):
            unit = b"".join(self._part(k, at, self.size)[0] for k in range(bisect_right(self.starts, at) - 1, len(self.pieces)))
            return self.add((unit * (n // period + 1))[:n], n)
        while n:
            k = bisect_right(self.starts, at) - 1
            piece = self._part(k, at, at + n)
            self.add(*piece)
            at, n = at + piece[1], n - piece[1]

    def _part(self, k: int, lo: int, hi: int) -> tuple[bytes | None, int, int]:
        """What of piece ``k`` lies between two places of the target."""
        data, n, place = self.pieces[k]
        a, b = max(lo - self.starts[k], 0), min(hi - self.starts[k], n)
        return (None, b - a, place + a) if data is None else (data[a:b], b - a, 0)

    def into(self, patch: Patch) -> Patch:
        patch.records = [(at, data) for at, (data, _, _) in zip(self.starts, self.pieces) if data is not None]
        patch.copies = [(at, n, place) for at, (data, n, place) in zip(self.starts, self.pieces) if data is None]
        return patch


def _bps(patch: bytes, kind: str) -> Patch:
    need(len(patch) >= 19 and _crc(patch[:-4]) == patch[-4:], "patch checksum")
    n, at = varint(patch, 4)
    m, at = varint(patch, at)
    extra, at = varint(patch, at)
    at += extra
    out, end = Target(), len(patch) - 12
    places = [0, 0]  # in the source, in the target
    while at < end:
        head, at = varint(patch, at)
        action, size = head & 3, (head >> 2) + 1
        need(out.size + size <= m, "more than the target's size")
        if action == 0:
            need(out.size + size <= n, "outside the source")
            out.add(None, size, out.size)
        elif action == 1:
            need(at + size <= end, "truncated record")
            out.add(patch[at : at + size], size)
            at += size
        else:
            v, at = varint(patch, at)
            place = places[action - 2] + (-(v >> 1) if v & 1 else v >> 1)
            places[action - 2] = place + size
            if action == 2:
                need(0 <= place <= n - size, "outside the source")
                out.add(None, size, place)
            else:
                out.again(place, size)
    need(out.size == m, "less than the target's size")
    return out.into(Patch(source_size=n, target_size=m, source_crc=int.from_bytes(patch[-12:-8], "little"), target_crc=int.from_bytes(patch[-8:-4], "little")))


def _vcd_codes() -> list[list[tuple[str, int, int]]]:
    """The default table: one or two instructions (what, size or 0 for one that follows, mode of the address) for each code."""
    codes = [[("run", 0, 0)], *[[("add", n, 0)] for n in range(18)]]
    codes += [[("copy", n, mode)] for mode in range(9) for n in (0, *range(4, 19))]
    codes += [[("add", a, 0), ("copy", c, mode)] for mode in range(6) for a in range(1, 5) for c in range(4, 7)]
    codes += [[("add", a, 0), ("copy", 4, mode)] for mode in range(6, 9) for a in range(1, 5)]
    return codes + [[("copy", 4, mode), ("add", 1, 0)] for mode in range(9)]


def _vcd_number(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the highest first, all but the last marked; and what follows it."""
    value = 0
    while True:
        need(at < len(data), "truncated number")
        value, at = value << 7 | data[at] & 127, at + 1
        if data[at - 1] < 128:
            return value, at


def _vcdiff(patch: bytes, kind: str) -> Patch:
    need(len(patch) >= 5, "truncated header")
    need(patch[3] == 0 and not patch[4] & 3, "a secondary compression or a table of its own")
    at, out, most = 5, Target(), 0
    if patch[4] & 4:  # an application's own header
        n, at = _vcd_number(patch, at)
        at += n
    while at < len(patch):
        how, at = patch[at], at + 1
        need(how in (0, 1, 5, 4, 2, 6), "unknown window")
        length = place = 0
        if how & 3:
            length, at = _vcd_number(patch, at)
            place, at = _vcd_number(patch, at)
        _, at = _vcd_number(patch, at)
        target, at = _vcd_number(patch, at)
        need(at < len(patch) and patch[at] == 0, "a secondary compression")
        at += 1
        sizes = []
        for _ in range(3):
            n, at = _vcd_number(patch, at)
            sizes.append(n)
        at += 4 if how & 4 else 0  # a checksum of the window
        need(at + sum(sizes) <= len(patch), "truncated window")
        data, codes, places = (patch[at + sum(sizes[:k]) : at + sum(sizes[: k + 1])] for k in range(3))
        at += sum(sizes)
        if how & 1:
            most = max(most, place + length)
        _window(out, data, codes, places, length, place, bool(how & 2), target)
    done = out.into(Patch(target_size=out.size))
    done.check_at, done.check = (most, b"") if most else (None, None)  # the source must reach so far
    return done


def _window(out: Target, data: bytes, codes: bytes, places: bytes, length: int, place: int, of_target: bool, target: int) -> None:
    """A window's instructions: addresses below ``length`` are in its segment of the source or the target, others in the window."""
    begin, d, c, p = out.size, 0, 0, 0
    near, slot, same = [0] * 4, 0, [0] * 768
    while c < len(codes):
        code, c = codes[c], c + 1
        for what, size, mode in _VCD[code]:
            if not size:
                size, c = _vcd_number(codes, c)
            need(out.size - begin + size <= target, "more than the window's size")
            if what == "copy":
                here = length + out.size - begin
                if mode >= 6:
                    need(p < len(places), "truncated record")
                    address, p = same[(mode - 6) * 256 + places[p]], p + 1
                else:
                    n, p = _vcd_number(places, p)
                    address = n if mode == 0 else here - n if mode == 1 else near[mode - 2] + n
                need(0 <= address < here, "outside the target")
                near[slot], slot, same[address % 768] = address, (slot + 1) % 4, address
                inside = min(size, max(0, length - address))
                if inside and of_target:
                    out.again(place + address, inside)
                elif inside:
                    out.add(None, inside, place + address)
                if size > inside:
                    out.again(begin + address + inside - length, size - inside)
            else:
                n = 1 if what == "run" else size
                need(d + n <= len(data), "truncated record")
                out.add(data[d : d + n] * (size if what == "run" else 1), size)
                d += n
    need(out.size - begin == target, "less than the window's size")


class Encoder:
    """Records in order as a patch; ``sizes`` and ``crcs``: of source and target."""

    def __init__(self, kind: str, sizes: tuple[int, int], crcs: tuple[int, int]):
        need(kind not in ("ips", "ips32") or sizes[1] >= sizes[0], "the format cannot shorten")
        need(kind not in _WIDTHS or sizes[1] <= 1 << 8 * _WIDTHS[kind], "the target is too large for the format")
        need(kind not in ("aps", "ppf") or sizes[0] == sizes[1], "the format cannot change the size")
        self.kind, self.sizes, self.crcs, self.last = kind, sizes, crcs, 0
        head = {"ups": lambda: b"".join(map(to_varint, sizes)), "bps": lambda: b"".join(map(to_varint, (*sizes, 0))), "vcdiff": lambda: b"\0\0", "ppf": lambda: b"30" + bytes([2]) + b"".ljust(50) + bytes(4)}
        self.out = bytearray(MAGIC[kind] + head.get(kind, bytes)())
        self.sections = [bytearray() for _ in range(3)]  # of a window: data, instructions, addresses

    def add(self, offset: int, body: bytes) -> None:
        if self.kind in _WIDTHS:
            run = len(body) > 8 and body == body[:1] * len(body)
            self.out += offset.to_bytes(_WIDTHS[self.kind]) + (b"\0\0" + len(body).to_bytes(2) + body[:1] if run else len(body).to_bytes(2) + body)
        elif self.kind in ("bps", "vcdiff"):
            self._kept(offset)
            self._new(body)
            self.last = offset + len(body)
        elif self.kind == "ups":
            self.out += to_varint(offset - self.last) + body + b"\0"
            self.last = offset + len(body) + 1
        else:
            self.out += offset.to_bytes(4 if self.kind == "aps" else 8, "little") + bytes([len(body)]) + body

    def _kept(self, upto: int) -> None:
        """What is as it was in the source."""
        if (n := upto - self.last) and self.kind == "bps":
            self.out += to_varint((n - 1) << 2)
        elif n:
            self.sections[1] += b"\x13" + _to_vcd(n)
            self.sections[2] += _to_vcd(self.last)

    def _new(self, body: bytes) -> None:
        if self.kind == "bps":
            self.out += to_varint((len(body) - 1) << 2 | 1) + body
        else:
            self.sections[0] += body
            self.sections[1] += b"\x01" + _to_vcd(len(body))

    def done(self) -> bytes:
        if self.kind in ("bps", "vcdiff"):
            self._kept(self.sizes[1])
        if self.kind == "vcdiff" and self.sizes[1]:
            body = _to_vcd(self.sizes[1]) + b"\0" + b"".join(_to_vcd(len(x)) for x in self.sections) + b"".join(self.sections)
            self.out += (b"\1" + _to_vcd(self.sizes[0]) + _to_vcd(0) if self.sizes[0] else b"\0") + _to_vcd(len(body)) + body
        if self.kind in ("ups", "bps"):
            self.out += b"".join(c.to_bytes(4, "little") for c in self.crcs)
            self.out += _crc(bytes(self.out))
        return bytes(self.out) + _ENDS.get(self.kind, b"")


def _crc(data: bytes) -> bytes:
    return zlib.crc32(data).to_bytes(4, "little")


def _to_vcd(value: int) -> bytes:
    out = bytes([value & 127])
    while value := value >> 7:
        out = bytes([value & 127 | 128]) + out
    return out


_VCD = _vcd_codes()
