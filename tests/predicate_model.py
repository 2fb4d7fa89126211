"""The filter language in plain Python, to hold the compiled columns against."""

MISSING = object()


def resolve(doc, path):
    for key in path.split("."):
        if not isinstance(doc, dict) or key not in doc:
            return MISSING
        doc = doc[key]
    return doc


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def ordered(a, b):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return number(a) and number(b) or isinstance(a, str) and isinstance(b, str)


def leaf(v, op, x):
    here = v is not MISSING
    return {
        "$eq": lambda: here and same(v, x),
        "$ne": lambda: not (here and same(v, x)),
        "$gt": lambda: here and ordered(v, x) and v > x,
        "$gte": lambda: here and ordered(v, x) and v >= x,
        "$lt": lambda: here and ordered(v, x) and v < x,
        "$lte": lambda: here and ordered(v, x) and v <= x,
        "$in": lambda: here and any(same(v, y) for y in x),
        "$nin": lambda: not (here and any(same(v, y) for y in x)),
        "$exists": lambda: here == x,
        "$contains_any": lambda: isinstance(v, list) and any(same(e, y) for e in v for y in x),
        "$contains_all": lambda: isinstance(v, list) and all(any(same(e, y) for e in v) for y in x),
    }[op]()


def matches(doc, f):
    for key, value in f.items():
        if key == "$and":
            ok = all(matches(doc, x) for x in value)
        elif key == "$or":
            ok = any(matches(doc, x) for x in value)
        elif isinstance(value, dict) and any(k.startswith("$") for k in value):
            ok = all(leaf(resolve(doc, key), op, x) for op, x in value.items())
        else:
            ok = leaf(resolve(doc, key), "$eq", value)
        if not ok:
            return False
    return True
