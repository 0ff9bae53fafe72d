"""Survey files for tests: lines of 84 bytes with fields at their places."""


def line(*fields: tuple[int, str | bytes]) -> bytes:
    out = bytearray(b" " * 84)
    for offset, text in fields:
        raw = text if isinstance(text, bytes) else text.encode("cp932")
        out[offset : offset + len(raw)] = raw
    return bytes(out)


def mesh(zone: str = "08", level: str = " 2500", north: str = "0000", east: str = "0000") -> list[bytes]:
    return [line((0, "M "), (2, f"{zone}DF244"), (30, level), (65, " 0")), line((0, " 100000"), (7, " 200000"), (44, "999")), line(), line((9, "0")), line((40, north), (44, east))]


def element(kind: int, code: str = "2100", following: str = "2", count: int = 0, rows: int = 0, *more: tuple[int, str]) -> bytes:
    return line((0, f"E{kind}"), (2, code), (20, following), (27, f"{count:4d}"), (31, f"{rows:4d}"), *more)


def coordinates(*yx: tuple[int, int]) -> list[bytes]:
    """Rows of six points each, northing first."""
    return [line(*((14 * k + 7 * j, f"{v:7d}") for k, p in enumerate(yx[i : i + 6]) for j, v in enumerate(p))) for i in range(0, len(yx), 6)]


def content(*lines: bytes) -> bytes:
    return b"".join(x + b"\r\n" for x in lines)
