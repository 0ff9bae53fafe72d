"""Published folders: replaced as a whole, bundles of what a map needs, styles with a way back."""

from __future__ import annotations

import base64
import os
import shutil
import uuid

MOST_BODY = 20 << 20
SPRITES = ("sprite.json", "sprite.png", "sprite@2x.json", "sprite@2x.png")
PNG = b"\x89PNG\r\n\x1a\n"


def replace_folder(made: str, target: str) -> None:
    """Moves ``made`` to ``target``; what was there comes back if that fails."""
    backup = f"{target}.backup-{uuid.uuid4().hex}"
    had = os.path.exists(target)
    if had:
        os.rename(target, backup)
    try:
        os.rename(made, target)
    except OSError:
        if had:
            os.rename(backup, target)
        raise
    if had:
        shutil.rmtree(backup) if os.path.isdir(backup) else os.remove(backup)


def inside(root: str, relative: str) -> str:
    """The path of a file below ``root``; ValueError if it is not below it."""
    path = os.path.realpath(os.path.join(root, relative))
    if os.path.commonpath([os.path.realpath(root), path]) != os.path.realpath(root):
        raise ValueError(f"outside the folder: {relative}")
    return path


def create_bundle(archive: str, style: str, assets: str, levels: list[int], output: str) -> list[str]:
    """Copies archive, style, sprites and glyphs into an empty folder; only data of one level make a bundle."""
    if len(levels) != 1:
        raise ValueError("a bundle has one level")
    if os.path.isdir(output) and os.listdir(output):
        raise FileExistsError(output)
    os.makedirs(output, exist_ok=True)
    copied = []

    def copy(source: str, name: str) -> None:
        target = os.path.join(output, name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.copyfile(source, target)
        copied.append(name)

    copy(archive, os.path.basename(archive))
    copy(style, "style.json")
    for s in SPRITES:
        if os.path.exists(p := os.path.join(assets, s)):
            copy(p, s)
    for folder, _, files in os.walk(os.path.join(assets, "glyphs")):
        for f in sorted(files):
            if f.endswith(".pbf"):
                copy(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), assets))
    return copied


def prepare_distribution(output: str, build) -> bool:
    """Builds a folder with ``build`` unless it is there already; whether it was built."""
    if os.path.exists(os.path.join(output, "style.json")):
        return False
    build(output)
    return True


def decode_png(url: str) -> bytes:
    """The bytes of a PNG data URL."""
    head = "data:image/png;base64,"
    if not url.startswith(head) or len(url) > MOST_BODY:
        raise ValueError("not a PNG data URL")
    data = base64.b64decode(url[len(head) :], validate=True)
    if not data.startswith(PNG):
        raise ValueError("not a PNG picture")
    return data


def publish(folder: str, files: dict[str, bytes], rename=os.rename) -> None:
    """Puts new files in place of old ones, all or none; errors of the way back are raised with the first one."""
    for name in files:
        inside(folder, name)
    mark = uuid.uuid4().hex
    staged = {n: f"{folder}/.{n}.{mark}.new" for n in files}
    for n, body in files.items():
        with open(staged[n], "wb") as f:
            f.write(body)
    done: list[tuple[str, str | None]] = []
    try:
        for n in files:
            target, old = f"{folder}/{n}", None
            if os.path.exists(target):
                old = f"{folder}/.{n}.{mark}.old"
                rename(target, old)
            done.append((target, old))
            rename(staged[n], target)
    except OSError as first:
        errors: list[Exception] = [first]
        for target, old in reversed(done):
            try:
                if old:
                    os.replace(old, target)
                elif os.path.exists(target):
                    os.remove(target)
            except OSError as e:
                errors.append(e)
        for p in staged.values():
            if os.path.exists(p):
                os.remove(p)
        raise ExceptionGroup("publishing failed", errors) from first
    for _, old in done:
        if old:
            os.remove(old)


def asset_root(output: str, packaged: str, built_in: str) -> str:
    """Where assets come from: a folder with a style, else what is packaged, else what is built in."""
    for root in (output, packaged):
        if os.path.exists(os.path.join(root, "style.json")):
            return root
    return built_in


def pack_atlas(icons: list[tuple[str, int, int]], columns: int = 10, cell: int = 32) -> tuple[int, int, dict[str, dict]]:
    """(width, height, frames) of an atlas with ten icons to a row, each centred in its row's height. Icons: name, width, height."""
    frames, y, width = {}, 0, 0
    for k in range(0, len(icons), columns):
        row = icons[k : k + columns]
        tall, x = max(max(h for _, _, h in row), cell), 0
        for name, w, h in row:
            frames[name] = {"x": x, "y": y + (tall - h) // 2, "width": w, "height": h, "pixelRatio": 1}
            x += max(w, cell)
        width, y = max(width, x), y + tall
    return width, y, frames


def recolor(pixels: bytes, rgb: tuple[int, int, int]) -> bytes:
    """RGBA pixels in one colour: what was dark covers."""
    out = bytearray(len(pixels))
    for k in range(0, len(pixels), 4):
        mean = sum(pixels[k : k + 3]) / 3
        out[k : k + 4] = bytes((*rgb, int(pixels[k + 3] * (255 - mean) / 255 + 0.5)))
    return bytes(out)


def append_frame(frames: dict[str, dict], height: int, name: str, size: tuple[int, int]) -> tuple[dict[str, dict], int]:
    """An atlas with one more frame below the others; one that is there is used again."""
    if name in frames:
        return frames, height
    return frames | {name: {"x": 0, "y": height, "width": size[0], "height": size[1], "pixelRatio": 1}}, height + size[1]
