"""What tests share."""

DATA = "/root/testdata/sf0.001"


def values(rows, columns):
    """Rows as sorted tuples in the order of sorted columns, numbers made comparable."""
    from decimal import Decimal

    def one(v):
        if isinstance(v, bool) or v is None:
            return ("", v)
        if isinstance(v, (float, Decimal)):
            return (0, round(float(v), 6) + 0.0)
        return (0, v) if isinstance(v, int) else ("s", str(v))

    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(one(r[i]) for i in at) for r in rows), key=str)
