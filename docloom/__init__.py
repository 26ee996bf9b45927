"""docloom: document collections as Spark tables."""

__version__ = "0.1.0"


def convert(data: bytes | str, source: str, target: str) -> bytes:
    """One document converted in process; images go along into formats that embed them."""
    from docloom.plans.documents import read_one, write_one

    doc, media = read_one(data, source)
    return write_one(doc, target, media)
