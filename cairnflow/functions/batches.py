"""Arrow batches in small pieces: what a Python worker makes of a batch is never there as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: A piece ends at so many rows or bytes of text.
ROWS, BYTES = 256, 1 << 18


def pieces(sizes: Iterable[int | None], rows: int = ROWS, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows of the given sizes (null: 0): at most rows rows and most bytes, or one row."""
    start = total = 0
    sizes = [n or 0 for n in sizes]
    for k, size in enumerate(sizes):
        if k > start and (k - start >= rows or total + size > most):
            yield start, k - start
            start, total = k, 0
        total += size
    if sizes:
        yield start, len(sizes) - start


def text_sizes(*columns) -> list[int]:
    """Bytes of text of each row of Arrow columns of strings or lists of strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def of(c) -> list[int | None]:
        if not pa.types.is_list(c.type):
            return pc.binary_length(c).to_pylist()
        ends = [0, *pc.cumulative_sum(pc.fill_null(pc.binary_length(c.flatten()), 0)).to_pylist()]
        counts, at, sizes = pc.fill_null(pc.list_value_length(c), 0).to_pylist(), 0, []
        for n in counts:
            sizes.append(ends[at + n] - ends[at])
            at += n
        return sizes

    return [sum(n or 0 for n in row) for row in zip(*[of(c) for c in columns], strict=True)]


def in_pieces(f: Callable, kind: str) -> Callable:
    """f of each value that isn't null, for an Arrow UDF over iterators of columns; kind: string, or list (of strings)."""

    def run(columns: Iterator) -> Iterator:
        import pyarrow as pa

        made = pa.string() if kind == "string" else pa.list_(pa.string())
        for c in columns:
            if not len(c):
                yield pa.array([], made)
            for start, n in pieces(text_sizes(c)):
                yield pa.array([None if x is None else f(x) for x in c.slice(start, n).to_pylist()], made)

    return run
