"""Scalar Column functions: text normalisation, classes, dates, planar geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street types that a name may end with; tokens of an organisation's name; suffixes that do not tell businesses apart.
STREET_TYPES = ("ST", "AVE", "BLVD", "RD", "DR", "WAY", "PKWY")
BUSINESS_TOKENS = tuple(
    """
    INC INCORPORATED LLC LLP LP CORP CORPORATION CO COMPANY LTD LIMITED
    TRUST HOLDINGS HOLDING GROUP ENTERPRISES ENTERPRISE PARTNERS ASSOCIATES
    RENTAL RENTALS LEASING LEASE LSE LSR FLEET FLEETS
    SERVICES SERVICE SYSTEMS SYSTEM SOLUTIONS LOGISTICS TRANSPORT
    TRANSPORTATION TRUCKING EXPRESS DELIVERY DISTRIBUTORS DISTRIBUTING
    CONSTRUCTION CONTRACTORS PLUMBING ELECTRIC MECHANICAL
    BANK FINANCIAL CREDIT INSURANCE MOTORS AUTO AUTOMOTIVE
    HOSPITAL MEDICAL HEALTH CLINIC UNIVERSITY COLLEGE SCHOOL CHURCH
    FOUNDATION INSTITUTE ASSOCIATION SOCIETY COUNCIL AUTHORITY
    DEPT DEPARTMENT CITY COUNTY STATE FEDERAL MUNICIPAL
    RESTAURANT PIZZA CATERING FOODS BEVERAGE BREWING
    PROPERTIES REALTY MANAGEMENT DEVELOPMENT BUILDERS
    """.split()
)
BUSINESS_SUFFIXES = tuple("INC INCORPORATED LLC LLP LP CORP CORPORATION CO COMPANY LTD LT LIMITED TRUST LSE LSR THE".split())
SEVERITY = {"error": "fatal", "purchase": "incapacitating", "signup": "non_incapacitating", "click": "reported_not_evident"}


def street_name(c: Column) -> Column:
    """Upper case, spaces collapsed, one trailing street type removed from names of two words or more."""
    up = F.regexp_replace(F.upper(F.trim(c)), r"\s+", " ")
    return F.regexp_replace(up, rf"\s({'|'.join(STREET_TYPES)})$", "")


def slug(c: Column) -> Column:
    """Lower case, runs of what is neither letter nor number (of any script) as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def severity(event_type: Column) -> Column:
    """Looked up by a map; anything else is unknown."""
    pairs = [F.lit(x) for kv in SEVERITY.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[event_type], F.lit("unknown"))


def yes_no(c: Column) -> Column:
    return F.coalesce(F.upper(c) == "Y", F.lit(False))


def _name_words(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", " "))


def registrant_class(last: Column, first: Column, tokens: tuple[str, ...] = BUSINESS_TOKENS) -> Column:
    """individual if there is a first name; else business if a word of the last is a business token; else unknown."""
    business = F.arrays_overlap(F.split(_name_words(last), " "), F.array(*map(F.lit, tokens)))
    return F.when(F.coalesce(F.trim(first), F.lit("")) != "", "individual").when(business, "business").otherwise("unknown")


def business_fold(name: Column, suffixes: tuple[str, ...] = BUSINESS_SUFFIXES) -> Column:
    """Suffixes and numbers of four digits or more go from the tail, again and again; then suffixes from the head."""
    any_of = "|".join(suffixes)
    return F.trim(F.regexp_replace(F.regexp_replace(_name_words(name), rf"(^|\s+)((({any_of}|[0-9]{{4,}})(\s+|$))+)$", ""), rf"^(({any_of})(\s+|$))+", ""))


def redacted(last: Column, first: Column) -> Column:
    """The name of a business, nothing of anyone else."""
    return F.when(registrant_class(last, first) == "business", F.trim(last)).otherwise("")


def is_warning(description: Column, fine: Column) -> Column:
    """No fine, a fine of zero, or the word WARNING."""
    return fine.isNull() | (fine == 0) | F.contains(F.upper(F.coalesce(description, F.lit(""))), F.lit("WARNING"))


def days_before(date_text: Column, n: int) -> Column:
    """ISO date n days earlier; null if it cannot be read."""
    return F.date_format(F.date_sub(F.to_date(F.try_to_timestamp(date_text, F.lit("yyyy-MM-dd"))), n), "yyyy-MM-dd")


def rfc_time(c: Column) -> Column:
    """UTC time of an RFC 2822 date, null if it cannot be read; the weekday is dropped first."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def without_source(title: Column, source: Column) -> Column:
    """The title without the name of its source behind it."""
    tail = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, tail), F.trim(F.substr(title, F.lit(1), F.length(title) - F.length(tail)))).otherwise(title)


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def clean_line(line: Column) -> Column:
    """Dashes of any kind (and the replacement character that stands for one) as a hyphen; blanks around go."""
    return F.trim(F.regexp_replace(line, "[\u2013\u2014\u2212\ufffd]", "-"))


def all_caps(text: Column) -> Column:
    """Whether a text has a letter and no lower-case one; false for null."""
    return F.coalesce((text == F.upper(text)) & F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def capped(text: Column, n: int = 600) -> Column:
    """Blanks collapsed; beyond n characters cut there, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n)), F.lit("\u2026"))).otherwise(flat)


def coordinate(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Struct (lat, lon) of doubles if both parse and lie in the box (south, west, north, east, inclusive), else null: "0" and (0, 0) are no places."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    good = F.coalesce(y.between(box[0], box[2]) & x.between(box[1], box[3]), F.lit(False))
    return F.when(good, F.struct(y.alias("lat"), x.alias("lon")))


def count_display(n: Column) -> Column:
    """Exact below 1000, to hundreds below 10000, else to thousands, with thousands separated."""
    step = F.when(n < 10_000, 100).otherwise(1000)
    near = (F.floor((n + step / 2) / step) * step).cast("long")
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.lit("about "), F.format_number(near, 0)))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Null where the denominator is null or not positive: missing is not zero."""
    return F.when(b > 0, a * scale / b)


# Planar geometry in metres; a line is a pair of end points, a ring an array of structs (x, y).


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    along = ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)
    t = F.when(dx * dx + dy * dy > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))).otherwise(0.0)
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross in their insides."""
    d1, d2 = side(*a, b[0], b[1]), side(*a, b[2], b[3])
    d3, d4 = side(*b, a[0], a[1]), side(*b, a[2], a[3])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def segment_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Zero for crossing segments, else the least distance of an end from the other segment."""
    ends = [point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b), point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a)]
    return F.when(segments_cross(a, b), 0.0).otherwise(F.least(*ends))


def inside_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting, half-open: a shared border belongs to one of two neighbours."""
    n = F.size(ring)

    def crossing(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        at = (q.x - p.x) * (py - p.y) / (q.y - p.y) + p.x
        return F.when(((p.y > py) != (q.y > py)) & (px < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crossing), F.lit(0), lambda a, b: a + b) % 2 == 1


def ring_crossings(line: tuple[Column, ...], ring: Column) -> Column:
    """The parameters t in (0, 1) at which a segment meets the edges of a ring."""
    x1, y1, x2, y2 = line
    dx, dy, n = x2 - x1, y2 - y1, F.size(ring)

    def meet(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        ex, ey = q.x - p.x, q.y - p.y
        det = dx * ey - dy * ex
        t = ((p.x - x1) * ey - (p.y - y1) * ex) / F.nullif(det, F.lit(0.0))
        s = ((p.x - x1) * dy - (p.y - y1) * dx) / F.nullif(det, F.lit(0.0))
        return F.when((t > 0) & (t < 1) & (s >= 0) & (s <= 1), t)

    return F.array_compact(F.transform(ring, meet))


def length_inside(line: tuple[Column, ...], ring: Column) -> Column:
    """Length of the part of a segment inside a ring, which may be concave: cut at crossings, keep pieces whose middle is inside."""
    x1, y1, x2, y2 = line
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), ring_crossings(line, ring)))
    pieces = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def kept(total: Column, piece: Column) -> Column:
        t = (piece.a + piece.b) / 2
        return total + F.when(inside_ring(x1 + t * (x2 - x1), y1 + t * (y2 - y1), ring), piece.b - piece.a).otherwise(0.0)

    return F.aggregate(pieces, F.lit(0.0), kept) * distance(x1, y1, x2, y2)


def utm16(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in UTM zone 16 north on GRS80, by the Krueger series to third order."""
    n = 0.0016792203946287  # third flattening of GRS80
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon + 87.0)
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * east, 0.9996 * a * north


def line_meeting(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Where two segments (x1, y1, x2, y2) meet: struct (x, y, kind) or null.

    A crossing or a touch is a point; lines that run along each other give the
    middle of the stretch they share (kind overlap).
    """
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    gx, gy = b[0] - a[0], b[1] - a[1]
    det, off, long = dx * ey - dy * ex, gx * dy - gy * dx, dx * dx + dy * dy
    t, u = (gx * ey - gy * ex) / F.nullif(det, F.lit(0.0)), off / F.nullif(det, F.lit(0.0))
    first, last = (gx * dx + gy * dy) / F.nullif(long, F.lit(0.0)), ((b[2] - a[0]) * dx + (b[3] - a[1]) * dy) / F.nullif(long, F.lit(0.0))
    low, high = F.greatest(F.lit(0.0), F.least(first, last)), F.least(F.lit(1.0), F.greatest(first, last))
    at = F.when(det != 0, F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), t)).when((off == 0) & (low <= high), (low + high) / 2)
    kind = F.when((det == 0) & (low < high), "overlap").otherwise("point")
    return F.when(at.isNotNull(), F.struct((a[0] + at * dx).alias("x"), (a[1] + at * dy).alias("y"), kind.alias("kind")))


def chain_length(line: Column, step) -> Column:
    """Length of an array of points by step(p, q), a distance of two neighbours."""
    n = F.size(line) - 1
    steps = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), step)
    return F.when(n > 0, F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def degree_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two near points in degrees; a degree of longitude shrinks with the latitude between them."""
    dx, dy = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * 111320.0, (lat2 - lat1) * 111320.0
    return F.sqrt(dx * dx + dy * dy)


def nearest_on_chain(px: Column, py: Column, line: Column) -> Column:
    """Struct (meters, x, y) of the point of a chain that is nearest to (px, py); the first on ties."""
    def near(p: Column, q: Column) -> Column:
        dx, dy = q.x - p.x, q.y - p.y
        along = ((px - p.x) * dx + (py - p.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        at = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0))
        x, y = p.x + at * dx, p.y + at * dy
        return F.struct(distance(px, py, x, y).alias("meters"), x.alias("x"), y.alias("y"))

    n = F.size(line) - 1
    return F.array_min(F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), near))


def box(line: Column, pad: float = 0.0) -> Column:
    """Struct (west, south, east, north) around an array of points, padded."""
    edge = lambda pick, c: pick(F.transform(line, lambda p: p[c]))
    return F.struct((edge(F.array_min, "x") - pad).alias("west"), (edge(F.array_min, "y") - pad).alias("south"), (edge(F.array_max, "x") + pad).alias("east"), (edge(F.array_max, "y") + pad).alias("north"))


def boxes_disjoint(a: Column, b: Column) -> Column:
    return (a.east < b.west) | (b.east < a.west) | (a.north < b.south) | (b.north < a.south)
