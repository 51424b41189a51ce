"""Geometry as column expressions, all inside whole-stage code generation.

A vector is a tuple of three columns, a rotation a tuple of nine (row by row). Quaternions are given as
x, y, z, w; ``wxyz`` sources name their columns accordingly. Angles are radians unless a name says degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def spherical(azimuth: Column, elevation: Column, distance: Column) -> Vector:
    flat = distance * F.cos(elevation)
    return flat * F.cos(azimuth), flat * F.sin(azimuth), distance * F.sin(elevation)


def rotation(qx: Column, qy: Column, qz: Column, qw: Column) -> tuple[Column, ...]:
    """The rotation of a quaternion of any length but 0."""
    n = qx * qx + qy * qy + qz * qz + qw * qw
    s = F.try_divide(F.lit(2.0), n)
    return (
        1 - s * (qy * qy + qz * qz), s * (qx * qy - qz * qw), s * (qx * qz + qy * qw),
        s * (qx * qy + qz * qw), 1 - s * (qx * qx + qz * qz), s * (qy * qz - qx * qw),
        s * (qx * qz - qy * qw), s * (qy * qz + qx * qw), 1 - s * (qx * qx + qy * qy),
    )


def rotate(r: tuple[Column, ...], v: Vector) -> Vector:
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def rotate_back(r: tuple[Column, ...], v: Vector) -> Vector:
    return tuple(r[i] * v[0] + r[i + 3] * v[1] + r[i + 6] * v[2] for i in range(3))


def to_parent(r: tuple[Column, ...], origin: Vector, v: Vector) -> Vector:
    """From a sensor's frame to the rig's, or from the rig's to the world's."""
    return tuple(a + b for a, b in zip(rotate(r, v), origin, strict=True))


def to_child(r: tuple[Column, ...], origin: Vector, v: Vector) -> Vector:
    """The inverse: world to rig, rig to camera."""
    return rotate_back(r, tuple(a - b for a, b in zip(v, origin, strict=True)))


def yaw(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    r = rotation(qx, qy, qz, qw)
    return F.atan2(r[3], r[0])


def yaw_sector(degrees: Column, sectors: int = 12) -> Column:
    """The sector 0 to sectors-1, 0 straight ahead."""
    width = 360.0 / sectors
    return F.floor(F.pmod(degrees + width / 2, F.lit(360.0)) / width).cast("int")


def wrap_degrees(angle: Column) -> Column:
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def in_front(x: Column, y: Column, degrees: float = 60.0, reach: float = 300.0) -> Column:
    """Inside the forward sector and its range."""
    return (F.abs(F.degrees(F.atan2(y, x))) <= degrees) & (F.hypot(x, y) <= reach)


def in_box(point: Vector, centre: Vector, size: Vector, r: tuple[Column, ...], margin: float = 1.3) -> Column:
    """Inside an oriented box whose size is stretched by the margin."""
    local = to_child(r, centre, point)
    out = F.lit(True)
    for a, s in zip(local, size, strict=True):
        out = out & (F.abs(a) <= s / 2 * margin)
    return out


def doppler_residual(point: Vector, measured: Column, velocity: Vector, ambiguity: Column | None = None, folds: int = 3) -> Column:
    """The least difference of a measured radial velocity, unfolded by up to ``folds`` intervals, from a static world's."""
    length = F.greatest(F.sqrt(point[0] * point[0] + point[1] * point[1] + point[2] * point[2]), F.lit(1e-6))
    expected = -(point[0] * velocity[0] + point[1] * velocity[1] + point[2] * velocity[2]) / length
    off = measured - expected
    return F.abs(off) if ambiguity is None else F.least(*[F.abs(off + k * ambiguity) for k in range(-folds, folds + 1)])


def polynomial(coefficients: Column, x: Column) -> Column:
    """The value of a polynomial given by an array, lowest order first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def project(v: Vector, poly: Column, centre: tuple[Column, Column], cde: tuple[Column, Column, Column], max_angle: Column) -> tuple[Column, Column]:
    """Pixel of a camera-frame point under an angle-polynomial lens; null behind the camera or beyond its angle."""
    radial = F.hypot(v[0], v[1])
    theta = F.atan2(radial, v[2])
    scale = F.when(radial > 1e-9, polynomial(poly, theta) / radial).otherwise(0.0)
    x, y = v[0] * scale, v[1] * scale
    seen = (theta <= max_angle) & (v[2] > 0)
    c, d, e = cde
    return F.when(seen, c * x + d * y + centre[0]), F.when(seen, e * x + y + centre[1])


def unproject(u: Column, v: Column, inverse: Column, centre: tuple[Column, Column], cde: tuple[Column, Column, Column]) -> Vector:
    """The unit ray of a pixel in the camera's frame."""
    c, d, e = cde
    a, b = u - centre[0], v - centre[1]
    det = c - d * e
    x, y = (a - d * b) / det, (c * b - e * a) / det
    radius = F.hypot(x, y)
    theta = polynomial(inverse, radius)
    flat = F.when(radius < 1e-9, F.lit(0.0)).otherwise(F.try_divide(F.sin(theta), radius))
    return x * flat, y * flat, F.when(radius < 1e-9, F.lit(1.0)).otherwise(F.cos(theta))


def camera_azimuth(u: Column, v: Column, inverse: Column, centre: tuple[Column, Column], cde: tuple[Column, Column, Column], r: tuple[Column, ...]) -> Column:
    """Degrees in the rig's frame, positive to the left."""
    ray = rotate(r, unproject(u, v, inverse, centre, cde))
    return F.degrees(F.atan2(ray[1], ray[0]))


def corners(centre: Vector, size: Vector, r: tuple[Column, ...]) -> list[Vector]:
    out = []
    for k in range(8):
        sign = [(0.5 if k >> (2 - i) & 1 else -0.5) for i in range(3)]
        out.append(to_parent(r, centre, tuple(s * f for s, f in zip(size, sign, strict=True))))
    return out


def image_box(pixels: list[tuple[Column, Column]], width: Column, height: Column, least_visible: int = 4) -> Column:
    """[x1, y1, x2, y2] of projected corners, clipped to the image; null if too few are seen or it is under two pixels."""
    seen = sum((F.when(u.isNotNull() & v.isNotNull(), 1).otherwise(0) for u, v in pixels), F.lit(0))
    clip = lambda x, top: F.least(F.greatest(x, F.lit(0.0)), top - 1)
    us, vs = [p[0] for p in pixels], [p[1] for p in pixels]
    x1, x2, y1, y2 = clip(F.least(*us), width), clip(F.greatest(*us), width), clip(F.least(*vs), height), clip(F.greatest(*vs), height)
    return F.when((seen >= least_visible) & (x2 - x1 >= 2) & (y2 - y1 >= 2), F.array(x1, y1, x2, y2))


def overlap(a: Column, b: Column) -> Column:
    """The common area of two boxes [x1, y1, x2, y2]."""
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    return side(0) * side(1)


def area(a: Column) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, F.try_divide(both, union)).otherwise(0.0)


def occluded(box: Column, nearer: Column) -> Column:
    """The share of a box that boxes nearer to the camera cover, at most 1."""
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(F.aggregate(nearer, F.lit(0.0), lambda s, o: s + overlap(box, o)), area(box)), F.lit(0.0)))


def to_frame(x: Column, y: Column, origin: tuple[Column, Column], heading: Column) -> tuple[Column, Column]:
    """World coordinates in the frame of a pose: forward and left."""
    dx, dy = x - origin[0], y - origin[1]
    return F.cos(heading) * dx + F.sin(heading) * dy, F.cos(heading) * dy - F.sin(heading) * dx


def nav_command(turn_degrees: Column, limit: float = 15.0) -> Column:
    return F.when(turn_degrees > limit, "LEFT").when(turn_degrees < -limit, "RIGHT").otherwise("STRAIGHT")


def ego_action(speed_change: Column, turn_degrees: Column, pace: float = 1.5, steer: float = 8.0) -> Column:
    """What the ego does: its pace and its steering."""
    first = F.when(speed_change > pace, "accelerating").when(speed_change < -pace, "braking").otherwise("steady")
    second = F.when(turn_degrees > steer, "turning left").when(turn_degrees < -steer, "turning right").otherwise("straight")
    return F.concat_ws(", ", first, second)


def object_attribute(kind: Column, speed: Column, limit: float = 1.0) -> Column:
    """moving; else standing for people, with_rider for riders, stopped for the rest; null without a speed."""
    still = F.when(kind == "person", "standing").when(kind == "rider", "with_rider").otherwise("stopped")
    return F.when(speed > limit, "moving").when(speed.isNotNull(), still)


def expected_static(point: Vector, velocity: Vector, yaw_rate: Column, seconds: float) -> tuple[Column, Column]:
    """Radial velocity and azimuth (degrees, after some seconds) that a static object at the point would have."""
    length = F.greatest(F.sqrt(point[0] * point[0] + point[1] * point[1] + point[2] * point[2]), F.lit(1e-6))
    radial = -(point[0] * velocity[0] + point[1] * velocity[1] + point[2] * velocity[2]) / length
    x, y = to_frame(point[0], point[1], (velocity[0] * seconds, velocity[1] * seconds), yaw_rate * seconds)
    return radial, F.degrees(F.atan2(y, x))


def grid_cell(x: Column, y: Column, sectors: int = 12, rings: int = 4, degrees: float = 60.0, reach: float = 40.0) -> Column:
    """The cell of a forward polar grid, or null outside."""
    az, rng = F.degrees(F.atan2(y, x)), F.hypot(x, y)
    sector = F.least(F.floor((az + degrees) / (2 * degrees) * sectors), F.lit(sectors - 1))
    return F.when((F.abs(az) <= degrees) & (rng < reach), (F.floor(rng / reach * rings) * sectors + sector).cast("int"))


def scale_pixels(value: Column, focal: float, other_focal: float) -> Column:
    """A length or angle in pixels as it would be under another focal length."""
    return value * F.lit(other_focal / focal)


# ---------------------------------------------------------------- trajectories as tokens


def encode_steps(points: Column, low: float, high: float, bins: int = 1000) -> Column:
    """Bin pairs of the steps between successive points (arrays [x, y]), the first from the origin."""
    width = (high - low) / (bins - 1)
    place = lambda v: F.least(F.greatest(F.bround((v - low) / width, 0), F.lit(0.0)), F.lit(bins - 1.0)).cast("int")
    before = F.concat(F.array(F.array(F.lit(0.0), F.lit(0.0))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))
    return F.zip_with(points, before, lambda p, q: F.array(place(p[0] - q[0]), place(p[1] - q[1])))


def decode_steps(codes: Column, low: float, high: float, bins: int = 1000) -> Column:
    """The points of bin pairs: running sums of the bins' centres."""
    width = (high - low) / (bins - 1)
    start = F.array().cast("array<array<double>>")

    def add(acc: Column, c: Column) -> Column:
        x, y = low + c[0] * width, low + c[1] * width
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.array(x + F.coalesce(last[0], F.lit(0.0)), y + F.coalesce(last[1], F.lit(0.0)))))

    return F.aggregate(codes, start, add)

