"""Symmetric 3 x 3 matrices in closed form: eigenvalues by the trigonometric root, the least one's vector by cross products.

All in expressions, so planes of any number of voxels are fitted inside the JVM."""

from __future__ import annotations

#: sxx .. szz -> l0 <= l1 <= l2.
VALUES = [
    ("q", "(sxx + syy + szz) / 3"),
    ("p", "sqrt(greatest((sxx - q) * (sxx - q) + (syy - q) * (syy - q) + (szz - q) * (szz - q) + 2 * (sxy * sxy + sxz * sxz + syz * syz), 0) / 6)"),
    ("det", "(sxx - q) * ((syy - q) * (szz - q) - syz * syz) - sxy * (sxy * (szz - q) - syz * sxz) + sxz * (sxy * syz - (syy - q) * sxz)"),
    ("phi", "CASE WHEN p < 1e-12 THEN 0.0 ELSE acos(least(greatest(det / (2 * p * p * p), -1.0), 1.0)) / 3 END"),
    ("l2", "q + 2 * p * cos(phi)"),
    ("l0", "q + 2 * p * cos(phi + 2 * pi() / 3)"),
    ("l1", "3 * q - l0 - l2"),
]
#: l0 -> its unit vector nx, ny, nz with nz >= 0 (0, 0, 1, which says nothing, where l1 is no larger than l0).
VECTOR = [
    ("abx", "sxy * syz - sxz * (syy - l0)"), ("aby", "sxz * sxy - (sxx - l0) * syz"), ("abz", "(sxx - l0) * (syy - l0) - sxy * sxy"),
    ("acx", "sxy * (szz - l0) - sxz * syz"), ("acy", "sxz * sxz - (sxx - l0) * (szz - l0)"), ("acz", "(sxx - l0) * syz - sxy * sxz"),
    ("bcx", "(syy - l0) * (szz - l0) - syz * syz"), ("bcy", "syz * sxz - sxy * (szz - l0)"), ("bcz", "sxy * syz - (syy - l0) * sxz"),
    ("nab", "abx * abx + aby * aby + abz * abz"), ("nac", "acx * acx + acy * acy + acz * acz"), ("nbc", "bcx * bcx + bcy * bcy + bcz * bcz"),
    ("pick", "CASE WHEN greatest(nab, nac, nbc) < 1e-24 THEN 0 WHEN nab >= nac AND nab >= nbc THEN 1 WHEN nac >= nbc THEN 2 ELSE 3 END"),
    ("long", "sqrt(greatest(nab, nac, nbc))"),
    ("side", "CASE WHEN (CASE pick WHEN 1 THEN abz WHEN 2 THEN acz ELSE bcz END) < 0 THEN -1.0 ELSE 1.0 END"),
    *[(f"n{a}", f"CASE pick WHEN 0 THEN {'1.0' if a == 'z' else '0.0'} WHEN 1 THEN side * ab{a} / long WHEN 2 THEN side * ac{a} / long ELSE side * bc{a} / long END") for a in "xyz"],
]
