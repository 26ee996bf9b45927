"""Images, the command line, and contents."""

import struct
import subprocess
import sys
from pathlib import Path

import pytest

from docloom.__main__ import main
from docloom.operators.outline import contents_html, number_sections
from docloom.operators.writers import write_text
from docloom.sources import media
from docloom.sources.markdown import read_markdown

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0) + b"crc_" + struct.pack(">I4sIIB", 9, b"pHYs", 11811, 11811, 1) + b"crc_"
JFIF = b"\xff\xd8\xff\xe0" + struct.pack(">H5sBBBHHBB", 16, b"JFIF\0", 1, 1, 1, 72, 72, 0, 0) + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 30, 40, 1)
TIFF = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 256, 3, 1, 7, 0) + struct.pack("<HHIHH", 257, 3, 1, 9, 0)


@pytest.mark.parametrize("data,kind,size", [
    (PNG, "png", (640, 480)), (JFIF, "jpeg", (40, 30)), (b"GIF89a" + struct.pack("<HH", 3, 4), "gif", (3, 4)), (TIFF, "tiff", (7, 9)),
    (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), "webp", (100, 50)),
    (b"<?xml version='1.0'?><!-- c --><svg width='2in' viewBox='0 0 10 5'/>", "svg", (192, 96)), (b"\xd7\xcd\xc6\x9a\0\0" + struct.pack("<hhhhH", 0, 0, 1440, 720, 1440), "wmf", (96, 48)),
])
def test_images(data, kind, size):
    found = media.inspect(data)
    assert (found.kind, found.width, found.height) == (kind, *size)
    for n in range(len(data)):
        media.inspect(data[:n])


def test_resolution_and_extent():
    assert media.inspect(PNG).dpi == pytest.approx((300, 300), rel=1e-3)
    assert media.inspect(JFIF).dpi == (72, 72)
    assert media.extent(media.Image("png", 96, 48)) == (914_400, 457_200)
    assert media.extent(media.Image("png", 0, 48)) is None and media.inspect(b"text") is None


def test_numbers_and_contents():
    blocks = read_markdown("## A\n\n#### B\n\n## C {.unnumbered}\n\n## D\n", "markdown")["blocks"]
    number_sections(blocks)
    assert [b["c"][1][2] for b in blocks] == [[["number", "1"]], [["number", "1.0.1"]], [], [["number", "2"]]]
    assert contents_html(blocks).count("<li>") == 3 and contents_html([]) == ""
    assert 'class="header-section-number"' in write_text({"blocks": blocks}, "html")


def test_command_line(tmp_path, capsysbinary):
    source = tmp_path / "a.md"
    source.write_text("# T\n\n![x](p.png)\n")
    (tmp_path / "p.png").write_bytes(PNG)
    assert main([str(source), "-o", str(tmp_path / "a.docx")]) == 0
    assert main([str(tmp_path / "a.docx"), "-t", "gfm", "--extract-media", str(tmp_path / "m")]) == 0
    assert b"# T" in capsysbinary.readouterr().out
    assert [p.read_bytes() for p in Path(tmp_path / "m").rglob("*.png")] == [PNG]
    assert main([str(source), "-t", "html", "-s", "--toc", "-N", "-M", "title=A *b*"]) == 0
    page = capsysbinary.readouterr().out
    assert b"<title>A b</title>" in page and b'<nav id="TOC"' in page
    assert main([str(source), "-t", "gfm+smart"]) == 1 and main([str(source), "-t", "nosuch"]) == 1 and main(["/no/such"]) == 1


def test_module_runs():
    root = Path(__file__).parent.parent
    out = subprocess.run([sys.executable, "-m", "docloom", "-f", "gfm", "-t", "plain"], input=b"*a*", capture_output=True, cwd=root, check=True)
    assert out.stdout == b"a\n"
