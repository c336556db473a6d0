"""Column expressions of the wrapping tile world and of its script values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILES, CHUNK, CHUNKS = 3072, 16, 192  # fixed values: tiles round the world, tiles a chunk, chunks round the world
ANY = -359  # fixed value: matches anything


def gap(a: Column, b: Column) -> Column:
    """Distance of two coordinates round the world."""
    d = F.abs(a - b)
    return F.least(d, TILES - d)


def chebyshev(ax: Column, ay: Column, bx: Column, by: Column, az: Column | None = None, bz: Column | None = None) -> Column:
    """Larger of the wrapped x and y distances, and of the plain z distance if given."""
    flat = [gap(ax, bx), gap(ay, by)]
    return F.greatest(*flat) if az is None else F.greatest(*flat, F.abs(az - bz))


def delta(a: Column, b: Column) -> Column:
    """Signed way from a to b round the world; both half-way edges fold over."""
    d = b - a
    return F.when(d >= TILES // 2, d - TILES).when(d <= -(TILES // 2), d + TILES).otherwise(d)


def direction(dx: Column, dy: Column) -> Column:
    """Eight-way direction, north 0 and clockwise; dy grows upwards. Octants part at tan 22.5 and 67.5 degrees (424, 2472 in 1024ths)."""
    t = F.call_function("div", 1024 * dy, F.when(dx == 0, 1).otherwise(dx))
    east = F.when(t >= 2472, 0).when(t >= 424, 1).when(t >= -424, 2).when(t >= -2472, 3).otherwise(4)
    west = F.when(t >= 2472, 4).when(t >= 424, 5).when(t >= -424, 6).when(t >= -2472, 7).otherwise(0)
    return F.when(dx == 0, F.when(dy > 0, 0).otherwise(4)).when(dx > 0, east).otherwise(west)


def matches(column: Column, wanted: int | Column) -> Column:
    """Equality with the wildcard; a literal wildcard leaves no predicate in the plan."""
    if isinstance(wanted, int):
        return F.lit(True) if wanted == ANY else column == wanted
    return (wanted == ANY) | (column == wanted)


def leading_int(s: Column) -> Column:
    """The integer a string begins with, else 0."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("long"))


LONGEST, SHORTEST = (1 << 63) - 1, -(1 << 63)


def divided(a: Column, b: Column, op: str = "div") -> Column:
    """Truncating a div b or a % b: nothing over x counts from 0, x over nothing is 0, over zero the end of the range."""
    x = F.coalesce(a, F.lit(0).cast("long"))
    end = F.when(x < 0, F.lit(SHORTEST)).otherwise(F.lit(LONGEST))
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    return F.when(b.isNull(), F.lit(0).cast("long")).when(b == 0, end).otherwise(F.call_function("div", x, safe) if op == "div" else x % safe)


def plus(a: Column, b: Column) -> Column:
    """An undefined operand is no operand."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def item(values: Column, i: Column) -> Column:
    """1-based element; 0 out of range."""
    return F.when(i >= 1, F.coalesce(F.get(values, (i - 1).cast("int")), F.lit(0))).otherwise(F.lit(0))


def a_or_an(s: Column) -> Column:
    return F.when(s.isNull() | F.substring(s, 1, 1).isin(*"aeiouyAEIOUY"), "an").otherwise("a")


def stack_frame(n: Column) -> Column:
    """Frame of a stack by its quantity."""
    return F.when(n > 12, 7).when(n > 6, 6).otherwise(n - 1)


def _nearer(a: Column, b: Column) -> Column:
    d = F.pmod(b - a, F.lit(TILES))
    return F.when(d >= TILES // 2, TILES - d).otherwise(d)


def square_distance(ax: Column, ay: Column, bx: Column, by: Column, az: Column | None = None, bz: Column | None = None) -> Column:
    """Squared way round the world, with the plain way in height if given."""
    dx, dy = _nearer(ax, bx), _nearer(ay, by)
    flat = dx * dx + dy * dy
    return flat if az is None else flat + (bz - az) * (bz - az)


def screen_distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Squared way on the screen, where height shifts both axes by half a tile."""
    dx, dy, dz = _nearer(ax, bx), _nearer(ay, by), bz - az
    x, y = dx * 2 - dz, dy * 2 - dz
    return F.call_function("div", x * x + y * y, F.lit(4))


def not_before(a: Column, b: Column) -> Column:
    """a >= b round the world; differences of half a world or more count the other way."""
    return F.when(a >= b, a - b < TILES // 2).otherwise(a - b < -(TILES // 2))


def footprint_gap(a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """Distance along an axis of two things that reach size tiles down from their anchors, from the edges that face."""
    way = delta(a, b)
    return F.when(way > 0, gap(a, F.pmod(b - (b_size - 1), F.lit(TILES)))).when(way < 0, gap(F.pmod(a - (a_size - 1), F.lit(TILES)), b)).otherwise(gap(a, b))


def height_gap(a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """Distance in height of two things that reach size up from their feet; none where they overlap."""
    low = F.when(a + a_size > b, 0).otherwise(b - a - a_size)
    high = F.when(b + b_size > a, 0).otherwise(a - b - b_size)
    return F.when(a < b, low).when(a > b, high).otherwise(0)


#: Steps to the neighbour in each direction, north first and clockwise (fixed values).
NEIGHBOURS = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def neighbours(x: Column, y: Column) -> Column:
    """array<struct<dir, x, y>> of the eight tiles round one, round the world."""
    return F.array(*[F.struct(F.lit(i).alias("dir"), F.pmod(x + dx, F.lit(TILES)).alias("x"), F.pmod(y + dy, F.lit(TILES)).alias("y")) for i, (dx, dy) in enumerate(NEIGHBOURS)])


def in_strip(start: Column, length: Column, at: Column) -> Column:
    return F.pmod(at - start, F.lit(TILES)) < length


def intersection(a: Column, b: Column) -> Column:
    """Of two rectangles (x, y, w, h); w or h is not positive where they do not meet."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.least(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.least(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))


def clock_after(day: Column, hour: Column, minute: Column, more: Column) -> Column:
    """(day, hour, minute) after an increment rounded to quarters of an hour; the minute of the clock is not rounded."""
    rounded = more + 7 - (more + 7) % 15
    new = minute + rounded
    hours = hour + F.call_function("div", new, F.lit(60))
    return F.struct((day + F.call_function("div", hours, F.lit(24))).alias("day"), (hours % 24).alias("hour"), (new % 60).alias("minute"))


def display_name(name: Column, quantity: Column) -> Column:
    """From a template first/stem/one/many: `first stem+one` of up to one, else `n stem+many`; too few parts give `?`."""
    part = lambda i: F.coalesce(F.get(F.split(name, "/"), F.lit(i)), F.lit(""))
    slashes = F.size(F.split(name, "/")) - 1
    rest = F.substring_index(name, "/", -1)
    singular = F.when(slashes < 3, "?").otherwise(F.concat(F.when(part(0) == "", "").otherwise(F.concat(part(0), F.lit(" "))), part(1), part(2)))
    plural = F.when(slashes < 3, "?").otherwise(F.concat(quantity.cast("string"), F.lit(" "), part(1), F.when(slashes == 3, rest).otherwise(F.regexp_extract(name, "^[^/]*/[^/]*/[^/]*/(.*)$", 1))))
    plain = F.when(quantity <= 1, name).otherwise(F.concat(quantity.cast("string"), F.lit(" "), name))
    return F.when(slashes == 0, plain).when(quantity <= 1, singular).otherwise(plural)


def effective(prop: str, value: Column, flags: dict[str, Column]) -> Column:
    """An actor's property under its flags: helpless, dead, charmed, asleep, might, cursed. Dexterity and combat pass every
    rule, intelligence those from death on, strength the last two; others stay."""
    strong = value
    rules = {"strength": 2, "intelligence": 1, "dexterity": 0, "combat": 0}
    if prop not in rules:
        return value
    if rules[prop] < 2:
        strong = F.when(flags["charmed"] | flags["asleep"], value - 1).otherwise(value)
    strong = F.when(flags["might"], strong + F.least(strong, F.lit(15))).otherwise(strong)
    strong = F.when(flags["cursed"], strong - 3).otherwise(strong)
    least = F.lit(0 if prop == "dexterity" else 1)
    if rules[prop] < 2:
        strong = F.when(flags["dead"], least).otherwise(strong)
    if rules[prop] < 1:
        strong = F.when(flags["helpless"] | flags["asleep"], least).otherwise(strong)
    return strong


def with_item(values: Column, i: Column, value: Column) -> Column:
    """The array with its 1-based element set; it grows with zeros, an index below 1 does nothing."""
    longer = F.concat(values, F.transform(F.filter(F.sequence(F.lit(0), F.greatest(i - F.size(values), F.lit(0)).cast("int")), lambda k: k > 0), lambda k: F.lit(0).cast("long")))
    return F.when(i < 1, values).otherwise(F.transform(longer, lambda x, k: F.when(k == i - 1, value).otherwise(x)))


def answers_after(answers: Column, add: Column | None = None, remove: Column | None = None) -> Column:
    """An ordered set of answers: what is removed goes, what is added moves to the end in its order, the last of equal ones."""
    kept = answers if remove is None else F.array_except(answers, remove)
    if add is None:
        return kept
    last = F.reverse(F.array_distinct(F.reverse(add)))
    return F.concat(F.filter(kept, lambda x: ~F.array_contains(last, x)), last)


def little_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned number of size bytes from place at (0-based) of a binary."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("long")
    return sum((F.shiftleft(byte(i), 8 * i) for i in range(1, size)), byte(0))


def bytes_of(value: Column, size: int) -> Column:
    """A number as size little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)]))


def swapped_nibbles(byte: Column) -> Column:
    return F.shiftleft(byte.bitwiseAND(15), 4).bitwiseOR(F.shiftright(byte, 4).bitwiseAND(15))
