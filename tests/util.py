import pandas as pd


def rows(frame):
    """A frame's rows as sorted text, columns by name and floats to six places, for comparing results of two engines."""
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(v.tolist())
        if isinstance(v, list):
            return str(v)
        if v is None or pd.isna(v):
            return "null"
        if isinstance(v, float):
            v = round(v, 6)
            return str(int(v)) if v.is_integer() else f"{v:.6f}"
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))
