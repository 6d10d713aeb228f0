"""Hexagonal grid cells (H3 index layout, public specification).

Validity, resolution and parents are bit arithmetic in Catalyst. Point to cell and cell to
centre need the icosahedron; they are Arrow UDFs over a few numpy formulas: gnomonic
projection onto the nearest face, aperture-7 digits, and faces unfolded across shared edges.
Joins never need them: they use plain latitude/longitude tiles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.functions.timex import col

# Fixed values of the public specification: face centres (latitude, longitude) in radians,
# azimuth from each centre to its first vertex, and the grid constants.
FACE_CENTRES = np.array([
    (0.803582649718989942, 1.248397419617396099),
    (1.307747883455638156, 2.536945009877921159),
    (1.054751253523952054, -1.347517358900396623),
    (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943),
    (0.172745327415618701, 1.678146885280433686),
    (0.605929321571350690, 2.953923329812411617),
    (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741),
    (-0.230961644455383637, 0.506495587332349035),
    (0.079066118549212831, 2.408163140208925497),
    (0.230961644455383637, -2.635097066257444203),
    (-0.172745327415618701, -1.463445768309359553),
    (-0.605929321571350690, -0.187669323777381622),
    (-0.427370518328979641, 1.252716453253507838),
    (-0.600191595538186799, 2.690988744120037492),
    (-0.491715428198773866, -2.739604450678486295),
    (-0.803582649718989942, -1.893195233972397139),
    (-1.307747883455638156, -0.604647643711872080),
    (-1.054751253523952054, 1.794075294689396615),
])
FACE_AZIMUTHS = np.array([
    5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400,
    2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
    5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535,
    2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
])
RES0_UNIT = 0.38196601125010500003
AP7_ROTATION = 0.333473172251832115336090755351601070065900389
# Home face and (i, j, k) of the 122 base cells, in index order.
BASE_CELLS = """
1100 2110 1000 2100 0200 1110 1001 2000 0100 2010 1010 1011 3100 3110 11200 4100 0000 6010 0001 2011
7001 2001 0110 6001 10200 6000 3000 11100 4110 3010 0011 4000 5010 0010 7010 11110 7000 10100 12200 6101
7101 4001 3001 3011 4010 6100 11000 8001 5001 14200 5000 12100 10110 4011 12110 7100 11010 10000 13200 10001
11001 9010 8010 6200 8000 9001 14100 5101 16011 8101 5100 12000 7200 12010 10010 9000 13100 16001 15011 15010
16010 14110 13110 5200 8100 14000 9101 14001 17001 12001 16000 17011 15001 16101 9100 15000 13000 8200 13010 17101
19010 14010 19011 17010 13001 17000 16100 9200 15101 15100 18011 18001 19001 17100 19000 18010 18101 19200 19100 18000
19101 18100
""".split()
# ccw order of the six directions, starting at i: their digits are 4i + 2j + k
CCW_DIGITS = np.array([4, 6, 2, 3, 1, 5])
TURN_OF_DIGIT = np.array([0, 4, 2, 3, 0, 5, 1])
SQRT7, SIN60 = np.sqrt(7.0), np.sqrt(3.0) / 2.0


# -- bits, in Catalyst ----------------------------------------------------------------------

def cell_bits(c) -> Column:
    return F.conv(F.lower(F.trim(col(c))), 16, 10).try_cast("bigint")


def cell_text(bits) -> Column:
    return F.lower(F.hex(col(bits)))


def cell_res(c) -> Column:
    """Resolution 0-15 of a valid cell, else null."""
    return F.when(is_cell(c), F.shiftright(cell_bits(c), 52).bitwiseAND(F.lit(15)).cast("int"))


def is_cell(c) -> Column:
    """Is the text a valid cell index? Null for null.

    The last 45 bits are fifteen octal digits: ``res`` of them from 0 to 6, then only sevens.
    """
    text = F.lower(F.trim(col(c)))
    bits = cell_bits(c)
    res = F.shiftright(bits, 52).bitwiseAND(F.lit(15))
    base = F.shiftright(bits, 45).bitwiseAND(F.lit(127))
    path = F.rtrim(F.substring(F.conv(text, 16, 8), -15, 15), F.lit("7"))
    # pentagons have no children along the k axis
    pentagons = [i for i, b in enumerate(BASE_CELLS) if b.endswith("200")]
    missing = base.isin(*pentagons) & F.ltrim(path, F.lit("0")).startswith("1")
    ok = (base < 122) & (F.length(path) == res) & ~path.contains("7") & ~missing
    return F.when(text.isNull(), None).when(text.rlike("^8[0-9a-f]{14}$"), ok).otherwise(F.lit(False))


def cell_parent(c, res: int) -> Column:
    """Ancestor at ``res``; null when the cell is coarser than that or invalid."""
    own = F.shiftright(cell_bits(c), 52).bitwiseAND(F.lit(15))
    keep = ((1 << 63) - 1) ^ (15 << 52)
    up = cell_bits(c).bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit((1 << 3 * (15 - res)) - 1))
    return F.when(is_cell(c) & (own >= res), cell_text(up))


def cell_ancestors(c) -> Column:
    """array of the cell and all its ancestors, coarsest first; just the text when it is not a cell."""
    parents = F.array_compact(F.array(*[cell_parent(c, r) for r in range(16)]))
    return F.when(F.coalesce(is_cell(c), F.lit(False)), parents).when(col(c).isNotNull(), F.array(col(c)))


# -- icosahedron ------------------------------------------------------------------------------

def _xyz(lat, lon):
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _azimuth(lat1, lon1, lat2, lon2):
    return np.arctan2(np.cos(lat2) * np.sin(lon2 - lon1),
                      np.cos(lat1) * np.sin(lat2) - np.sin(lat1) * np.cos(lat2) * np.cos(lon2 - lon1))


def _to_sphere(face, plane):
    """Inverse gnomonic projection of complex plane positions (resolution-0 units) on their faces."""
    lat0, lon0 = FACE_CENTRES[face, 0], FACE_CENTRES[face, 1]
    dist = np.arctan(np.abs(plane) * RES0_UNIT)
    az = FACE_AZIMUTHS[face] - np.angle(plane)
    lat = np.arcsin(np.clip(np.sin(lat0) * np.cos(dist) + np.cos(lat0) * np.sin(dist) * np.cos(az), -1, 1))
    lon = lon0 + np.arctan2(np.sin(az) * np.sin(dist) * np.cos(lat0), np.cos(dist) - np.sin(lat0) * np.sin(lat))
    return lat, (lon + np.pi) % (2 * np.pi) - np.pi


CORNERS = 2.0 * np.exp(1j * np.radians([0, 120, 240]))
EDGE_NORMALS = np.exp(1j * np.radians([60, 180, 300]))


@lru_cache(maxsize=1)
def _net():
    """For every face and edge: the face across it, and the rotation and shift between their planes."""
    faces = np.repeat(np.arange(20), 3)
    lat, lon = _to_sphere(faces, np.tile(CORNERS, 20))
    corner = _xyz(lat, lon).reshape(20, 3, 3)
    across, spin, shift = np.zeros((20, 3), int), np.zeros((20, 3), complex), np.zeros((20, 3), complex)
    for f in range(20):
        for e in range(3):
            ends = corner[f, [e, (e + 1) % 3]]
            for g in range(20):
                near = np.linalg.norm(corner[g][:, None] - ends[None], axis=-1) < 1e-6
                if g != f and near.any(axis=0).all():
                    there = CORNERS[near.argmax(axis=0)]
                    here = CORNERS[[e, (e + 1) % 3]]
                    spin[f, e] = (there[1] - there[0]) / (here[1] - here[0])
                    shift[f, e] = there[0] - spin[f, e] * here[0]
                    across[f, e] = g
    return across, spin, shift


def _unfold(face, plane):
    """Move positions that lie beyond an edge of their face onto the face across it."""
    across, spin, shift = _net()
    face, plane = face.copy(), plane.astype(complex)
    for _ in range(4):
        over = (plane[:, None] * np.conj(EDGE_NORMALS)[None]).real - 1.0
        edge = over.argmax(axis=1)
        out = over.max(axis=1) > 1e-9
        if not out.any():
            break
        f, e = face[out], edge[out]
        plane[out] = spin[f, e] * plane[out] + shift[f, e]
        face[out] = across[f, e]
    return face, plane


def _plane(i, j):
    return (i - 0.5 * j) + 1j * SIN60 * j


@lru_cache(maxsize=1)
def _base():
    """Tables by rule: (face, i, j, k) -> base cell and the turns from that face to the home face."""
    across, spin, _ = _net()
    home = np.array([int(b[:-3]) for b in BASE_CELLS])
    ijk = np.array([[int(d) for d in b[-3:]] for b in BASE_CELLS])
    centre = _plane(ijk[:, 0] - ijk[:, 2], ijk[:, 1] - ijk[:, 2])
    where = _xyz(*_to_sphere(home, centre))
    pentagon = (ijk == [2, 0, 0]).all(axis=1)
    cell = np.full((20, 3, 3, 3), -1)
    turns = np.zeros((20, 3, 3, 3), int)
    wedge = np.zeros((20, 3, 3, 3), int)
    for f in range(20):
        for i in range(3):
            for j in range(3):
                for k in range(3):
                    low = min(i, j, k)
                    g, p = _unfold(np.array([f]), np.array([_plane(i - k, j - k)]))
                    spot = _xyz(*_to_sphere(g, p))[0]
                    b = int(np.argmax(where @ spot))
                    cell[f, i, j, k] = b
                    if pentagon[b]:
                        corner = (i - low, j - low, k - low).index(2)
                        lat, lon = _to_sphere(home[[b]], centre[[b]])
                        ring = [h for h in range(20) if np.linalg.norm(
                            _xyz(*_to_sphere(np.full(3, h), CORNERS)) - spot, axis=1).min() < 1e-6]
                        az = _azimuth(lat[0], lon[0], FACE_CENTRES[ring, 0], FACE_CENTRES[ring, 1])
                        start = az[ring.index(home[b])]
                        steps = [ring[n] for n in np.argsort((az - start + 1e-9) % (2 * np.pi))].index(f)
                        wedge[f, i, j, k] = steps
                        # directions into the face: corner + 180 degrees here, 180 - 60 steps at home
                        turns[f, i, j, k] = -steps - 2 * corner
                    elif f != home[b]:
                        edge = int(np.flatnonzero(across[f] == home[b])[0])
                        turns[f, i, j, k] = round(np.degrees(np.angle(spin[f, edge])) / 60)
    return cell, turns % 6, wedge, home, ijk, pentagon


def point_to_bits(lat_deg, lon_deg, res: int) -> np.ndarray:
    """Cell indexes (int64) of positions in degrees."""
    lat, lon = np.radians(lat_deg), np.radians(lon_deg)
    cosine = _xyz(lat, lon) @ _xyz(FACE_CENTRES[:, 0], FACE_CENTRES[:, 1]).T
    face = cosine.argmax(axis=1)
    lat0, lon0 = FACE_CENTRES[face, 0], FACE_CENTRES[face, 1]
    dist = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
    theta = FACE_AZIMUTHS[face] - _azimuth(lat0, lon0, lat, lon) - (AP7_ROTATION if res % 2 else 0.0)
    radius = np.tan(dist) / RES0_UNIT * SQRT7 ** res
    # nearest hexagon: cube rounding on axes 60 degrees apart
    r = radius * np.sin(theta) / SIN60
    q = radius * np.cos(theta) - r / 2
    s = -q - r
    rq, rr, rs = np.rint(q), np.rint(r), np.rint(s)
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
    fix_q, fix_r = (dq > dr) & (dq > ds), (dr >= dq) & (dr > ds)
    rq = np.where(fix_q, -rr - rs, rq)
    rr = np.where(fix_r & ~fix_q, -rq - rs, rr)
    i, j = (rq + rr).astype(np.int64), rr.astype(np.int64)
    digits = np.zeros((len(face), res), int)
    for level in range(res, 0, -1):
        if level % 2:
            up_i, up_j = np.rint((3 * i - j) / 7), np.rint((i + 2 * j) / 7)
            mid_i, mid_j = 2 * up_i + up_j, 3 * up_j - up_i
        else:
            up_i, up_j = np.rint((2 * i + j) / 7), np.rint((3 * j - i) / 7)
            mid_i, mid_j = 3 * up_i - up_j, up_i + 2 * up_j
        di, dj = i - mid_i, j - mid_j
        low = np.minimum(np.minimum(di, dj), 0)
        digits[:, level - 1] = 4 * (di - low) + 2 * (dj - low) - low
        i, j = up_i.astype(np.int64), up_j.astype(np.int64)
    low = np.minimum(np.minimum(i, j), 0)
    cell, turns, wedge, _, _, pentagon = _base()
    at = (face, i - low, j - low, -low)
    base, turn = cell[at], turns[at].copy()
    pent = pentagon[base]
    if res and pent.any():
        # around a pentagon one of six sectors is missing: step over it on the side we came from
        nonzero = digits != 0
        lead = np.where(nonzero.any(axis=1), digits[np.arange(len(digits)), nonzero.argmax(axis=1)], 0)
        sector = (TURN_OF_DIGIT[lead] + turn) % 6
        missing = pent & (lead != 0) & (sector == 4)
        turn = turn + np.where(missing, np.where(wedge[at] <= 2, 1, -1), 0)
    spun = CCW_DIGITS[(TURN_OF_DIGIT[digits] + turn[:, None]) % 6]
    digits = np.where(digits == 0, 0, spun)
    bits = np.full(len(face), (1 << 59) | (res << 52), np.int64) | (base.astype(np.int64) << 45)
    for level in range(1, 16):
        value = digits[:, level - 1] if level <= res else np.full(len(face), 7)
        bits |= value.astype(np.int64) << (3 * (15 - level))
    return bits


def _home_plane(bits: int):
    """Home face and plane position of a cell (resolution-0 units), plus its resolution."""
    _, _, _, home, ijk, pentagon = _base()
    res, base = (bits >> 52) & 15, (bits >> 45) & 127
    digits = [(bits >> 3 * (15 - r)) & 7 for r in range(1, res + 1)]
    lead = next((d for d in digits if d), 0)
    if pentagon[base] and lead in (4, 5):
        digits = [int(CCW_DIGITS[(TURN_OF_DIGIT[d] - 1) % 6]) if d else 0 for d in digits]
    i, j = int(ijk[base, 0] - ijk[base, 2]), int(ijk[base, 1] - ijk[base, 2])
    for r, d in enumerate(digits, start=1):
        i, j = (2 * i + j, 3 * j - i) if r % 2 else (3 * i - j, i + 2 * j)
        i, j = i + (d >> 2 & 1) - (d & 1), j + (d >> 1 & 1) - (d & 1)
    turn = np.exp(1j * AP7_ROTATION) if res % 2 else 1.0
    return int(home[base]), _plane(i, j) * turn / SQRT7 ** res, res, turn, bool(pentagon[base] and not lead)


def cell_centres(bits) -> tuple[np.ndarray, np.ndarray]:
    parts = [_home_plane(int(b)) for b in bits]
    face, plane = _unfold(np.array([p[0] for p in parts], int), np.array([p[1] for p in parts], complex))
    lat, lon = _to_sphere(face, plane)
    return np.degrees(lat), np.degrees(lon)


def cell_corners(bits: int) -> tuple[np.ndarray, np.ndarray]:
    face, centre, res, turn, is_pentagon = _home_plane(int(bits))
    angles = np.radians([30, 90, 150, 210, 270] if is_pentagon else [30, 90, 150, 210, 270, 330])
    ring = centre + np.exp(1j * angles) / np.sqrt(3) * turn / SQRT7 ** res
    lat, lon = _to_sphere(*_unfold(np.full(len(ring), face), ring))
    return np.degrees(lat), np.degrees(lon)


# -- Arrow UDFs ---------------------------------------------------------------------------------

def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def cell_of(lat, lon, res: int) -> Column:
    """15-digit cell text of a position."""
    @F.pandas_udf(T.StringType())
    def encode(lats: pd.Series, lons: pd.Series) -> pd.Series:
        la, lo = lats.to_numpy("float64"), lons.to_numpy("float64")
        ok = np.isfinite(la) & np.isfinite(lo) & (abs(la) <= 90)
        out = np.full(len(la), None, object)
        if ok.any():
            out[ok] = [format(b, "x") for b in point_to_bits(la[ok], lo[ok], res)]
        return pd.Series(out, index=lats.index)
    return encode(col(lat).cast("double"), col(lon).cast("double"))


def cell_like(lat, lon, c) -> Column:
    """Cell of a position at the resolution of the cell ``c``; null where that is no cell."""
    @F.pandas_udf(T.StringType())
    def encode(lats: pd.Series, lons: pd.Series, resolutions: pd.Series) -> pd.Series:
        la, lo, res = (x.to_numpy("float64") for x in (lats, lons, resolutions))
        ok = np.isfinite(la) & np.isfinite(lo) & (abs(la) <= 90) & np.isfinite(res)
        out = np.full(len(la), None, object)
        for r in np.unique(res[ok]):
            at = ok & (res == r)
            out[at] = [format(b, "x") for b in point_to_bits(la[at], lo[at], int(r))]
        return pd.Series(out, index=lats.index)
    return encode(col(lat).cast("double"), col(lon).cast("double"), cell_res(c))


@F.pandas_udf(_doubles("lat", "lon"))
def _centre(cells: pd.Series) -> pd.DataFrame:
    codes, names = pd.factorize(cells)
    lat, lon = cell_centres([int(n, 16) for n in names]) if len(names) else (np.empty(0), np.empty(0))
    lat, lon = np.append(lat, np.nan), np.append(lon, np.nan)
    return pd.DataFrame({"lat": lat[codes], "lon": lon[codes]})


def cell_centre(c) -> Column:
    """struct(lat, lon); null for text that is not a cell."""
    return F.when(is_cell(c), _centre(F.when(is_cell(c), F.lower(F.trim(col(c))))))


@F.pandas_udf(_doubles("min_lat", "max_lat", "min_lon", "max_lon"))
def _bounds(cells: pd.Series) -> pd.DataFrame:
    codes, names = pd.factorize(cells)
    boxes = [[lat.min(), lat.max(), lon.min(), lon.max()] for lat, lon in (cell_corners(int(n, 16)) for n in names)]
    boxes.append([np.nan] * 4)
    return pd.DataFrame(np.array(boxes)[codes], columns=["min_lat", "max_lat", "min_lon", "max_lon"])


def cell_bounds(c) -> Column:
    """Extent of the cell's corners."""
    return F.when(is_cell(c), _bounds(F.when(is_cell(c), F.lower(F.trim(col(c))))))
