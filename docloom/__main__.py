"""python -m docloom FILE -f FROM -t TO: one document from and to files."""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path, PurePosixPath

from docloom import __version__, ast
from docloom.functions.text import FORMATS
from docloom.operators.outline import contents_html, number_sections
from docloom.operators.writers import html_page
from docloom.plans.documents import PACKAGES, READABLE, WRITABLE, read_one, write_one
from docloom.sources.markdown import inlines_of, State, DIALECTS


def named(name: str, known: tuple[str, ...]) -> str:
    """A format by its name or alias; extension syntax and unknown names are refused."""
    if re.search(r"[+-]", name):
        raise ast.DocumentError(f"{name}: extensions can't be switched")
    found = FORMATS.get(name.lower())
    if found not in known:
        raise ast.DocumentError(f"{name} isn't one of {', '.join(known)}")
    return found


def by_path(path: str | None, known: tuple[str, ...], default: str) -> str:
    ext = Path(path).suffix[1:] if path else ""
    return named(ext, known) if ext else default


def metadata_pair(text: str) -> tuple[str, dict]:
    """key or key=value; a bare key is true."""
    key, eq, value = text.partition("=")
    return key, ast.el("MetaBool", True) if not eq or value == "true" else ast.el("MetaInlines", inlines_of(value, State(DIALECTS["commonmark"])))


def extract(doc: dict, media: dict[str, bytes], folder: Path) -> None:
    """Writes media under folder and repoints images there; names that would leave the folder are refused."""
    places = {}
    for url, data in sorted(media.items()):
        parts = PurePosixPath(url).parts
        if ".." in parts or PurePosixPath(url).is_absolute() or ":" in url:
            raise ast.DocumentError(f"{url} would be written outside of {folder}")
        target = folder.joinpath(*parts)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
        places[url] = target.as_posix()
    for n in ast.walk(doc["blocks"]):
        if n["t"] == "Image" and n["c"][2][0] in places:
            n["c"][2][0] = places[n["c"][2][0]]


def beside(doc: dict, media: dict[str, bytes], folder: Path) -> dict[str, bytes]:
    """media, and of the images that it doesn't hold those that are files beside the document."""
    out = dict(media)
    for n in ast.walk(doc["blocks"]):
        url = n["c"][2][0] if n["t"] == "Image" else ""
        if url and url not in out and not re.match(r"[A-Za-z][\w+.-]*:|/", url) and (folder / url).is_file():
            out[url] = (folder / url).read_bytes()
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom", description="Convert a document.")
    p.add_argument("file", nargs="?")
    p.add_argument("-f", "--from", dest="source")
    p.add_argument("-t", "--to", dest="target")
    p.add_argument("-o", "--output")
    p.add_argument("-s", "--standalone", action="store_true")
    p.add_argument("--css")
    p.add_argument("--toc", action="store_true")
    p.add_argument("-N", "--number-sections", action="store_true")
    p.add_argument("-M", "--metadata", action="append", default=[])
    p.add_argument("--wrap", choices=("auto", "none", "preserve"), default="preserve")
    p.add_argument("--columns", type=int, default=72)
    p.add_argument("--extract-media")
    p.add_argument("-V", "--version", action="version", version=__version__)
    a = p.parse_args(args)
    try:
        source = named(a.source, READABLE) if a.source else by_path(a.file, READABLE, "markdown")
        target = named(a.target, WRITABLE) if a.target else by_path(a.output, WRITABLE, "html")
        data = Path(a.file).read_bytes() if a.file else sys.stdin.buffer.read()
        doc, media = read_one(data, source)
        doc["meta"] |= dict(metadata_pair(m) for m in a.metadata)
        if a.number_sections:
            number_sections(doc["blocks"])
        if a.extract_media:
            extract(doc, media, Path(a.extract_media))
        if target == "html" and (a.standalone or a.css or a.toc):
            out = html_page(doc, Path(a.css).read_text() if a.css else None, contents_html(doc["blocks"]) if a.toc else "").encode()
        else:
            out = write_one(doc, target, beside(doc, media, Path(a.file).parent if a.file else Path()) if target in PACKAGES else None, {"auto": a.columns, "none": 1 << 30}.get(a.wrap))
    except (ast.DocumentError, OSError) as e:
        print(f"docloom: {e}", file=sys.stderr)
        return 1
    if a.output:
        Path(a.output).write_bytes(out)
    else:
        sys.stdout.buffer.write(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
