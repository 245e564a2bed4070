"""Molecule strings: atom sets from tokens, a small parser, and key transforms with outside toolkits.

What follows from the tokens alone is a column expression. Canonical forms, fingerprints and
descriptors need a chemistry toolkit; those are registered as key transforms, and asking for one that is not
there raises MissingToolkit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An atom: in brackets with an optional isotope, or bare. Groups 1 and 2 are the symbols.
ATOM = r"\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)[^\]]*\]|(Br|Cl|[BCNOPSFI]|[bcnops])"
# The elements a usable molecule may hold, those that are common, and metals to flag.
ALLOWED = ("H", "Li", "B", "C", "N", "O", "F", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "K", "Ca", "Mn", "Fe", "Co", "Cu", "Zn", "As", "Se", "Br", "Mo", "Tc", "Ag", "Sn", "Sb", "I", "Gd", "Pt", "Au", "Bi")
COMMON = ("H", "B", "C", "N", "O", "F", "Si", "P", "S", "Cl", "Se", "Br", "I")
METALS = ("Mn", "Fe", "Co", "Cu", "Zn", "Mo", "Tc", "Ag", "Sn", "Gd", "Pt", "Au", "Bi")
# Inclusive bounds of molecular properties.
EXTREME_BOUNDS = {"MolWt": (32, 2048), "LogP": (-10, 12), "MolMR": (0, 512), "HeavyAtoms": (2, 128), "Heteroatoms": (0, 48), "TPSA": (0, 512), "HBA": (0, 24), "HBD": (0, 16), "RotatableBonds": (0, 32), "Rings": (0, 12)}
UNCOMMON_BOUNDS = {"MolWt": (32, 1024), "LogP": (-7, 11), "MolMR": (16, 288), "HeavyAtoms": (2, 80), "Heteroatoms": (0, 24), "TPSA": (0, 288), "HBA": (0, 16), "HBD": (0, 8), "RotatableBonds": (0, 20), "Rings": (0, 8)}
OUTLIER_BOUNDS = {"MolWt": (30, 1200), "MolLogP": (-7, 9), "MolMR": (0, 400), "TPSA": (0, 200), "NumHeavyAtom": (1, 100), "NumHAcceptors": (0, 24), "NumHDonors": (0, 12), "NumHeteroatoms": (0, 24), "NumRotatableBonds": (0, 32), "NumAliphaticRings": (0, 10), "NumAromaticRings": (0, 10)}


class MissingToolkit(RuntimeError):
    """The operator needs a chemistry toolkit that is not registered."""


def symbols(smiles: Column) -> Column:
    """The distinct element symbols of the atoms, sorted; aromatic atoms count as their element."""
    bracket = F.regexp_extract_all(smiles, F.lit(ATOM), F.lit(1))
    bare = F.regexp_extract_all(smiles, F.lit(ATOM), F.lit(2))
    names = F.filter(F.concat(bracket, bare), lambda s: s != "")
    return F.array_sort(F.array_distinct(F.transform(names, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1)))))


def _among(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def parse(text: str) -> tuple[list[dict], list[tuple[int, int, str]]] | None:
    """(atoms, bonds) of a SMILES string, or None if its grammar is broken.

    Atoms have symbol, aromatic, charge, hydrogens (None where implicit); bonds are (atom, atom, kind).
    Valences are not judged.
    """
    atoms: list[dict] = []
    bonds: list[tuple[int, int, str]] = []
    stack: list[int] = []
    rings: dict[str, tuple[int, str]] = {}
    last, kind, at = None, "", 0
    while at < len(text):
        c = text[at]
        if c == "[":
            stop = text.find("]", at)
            m = re.fullmatch(r"(\d*)([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2})(H\d*)?((?:\+\d*|-\d*|\++|-+)?)(:\d+)?", text[at + 1 : stop]) if stop > 0 else None
            if not m:
                return None
            charge = m[5]
            value = 0 if not charge else (len(charge) if len(set(charge)) == 1 else int(charge[1:])) * (1 if charge[0] == "+" else -1)
            new = {"symbol": m[2][0].upper() + m[2][1:], "aromatic": m[2][0].islower(), "charge": value, "hydrogens": int(m[4][1:] or 1) if m[4] else 0}
            at = stop + 1
        elif found := re.match(r"Br|Cl|[BCNOPSFI]|[bcnops]|\*", text[at:]):
            s = found[0]
            new = {"symbol": s[0].upper() + s[1:], "aromatic": s[0].islower(), "charge": 0, "hydrogens": None}
            at += len(s)
        elif c == "(" and last is not None:
            stack.append(last)
            at += 1
            continue
        elif c == ")" and stack and not kind:
            last = stack.pop()
            at += 1
            continue
        elif c in "-=#$:/\\" and not kind and last is not None:
            kind, at = c, at + 1
            continue
        elif c == "." and not kind and last is not None:
            last, at = None, at + 1
            continue
        elif (ring := re.match(r"%\d\d|\d", text[at:])) and last is not None:
            label = ring[0].lstrip("%").lstrip("0") or "0"
            if label in rings:
                other, theirs = rings.pop(label)
                if other == last or (kind and theirs and kind != theirs):
                    return None
                bonds.append((other, last, kind or theirs or _implied(atoms, other, last)))
            else:
                rings[label] = (last, kind)
            kind, at = "", at + len(ring[0])
            continue
        else:
            return None
        atoms.append(new)
        if last is not None:
            bonds.append((last, len(atoms) - 1, kind or _implied(atoms, last, len(atoms) - 1)))
        last, kind = len(atoms) - 1, ""
    return None if stack or rings or kind or last is None else (atoms, bonds)


def _implied(atoms: list[dict], i: int, j: int) -> str:
    return ":" if atoms[i]["aromatic"] and atoms[j]["aromatic"] else "-"


def issue(text: str | None) -> str | None:
    """"" for a string of sound grammar, else what is wrong; null for null."""
    if text is None:
        return None
    if not text.strip():
        return "Empty string"
    return "" if parse(text) else "Invalid SMILES"


def largest_fragment(text: str | None) -> str | None:
    """Of the parts between dots that with most heavy atoms, those with carbon first, then the first."""
    if text is None or not parse(text):
        return None
    size = lambda p: sum(a["symbol"] != "H" for a in parse(p)[0])
    carbon = lambda p: any(a["symbol"] == "C" for a in parse(p)[0])
    return max(text.split("."), key=lambda p: (carbon(p), size(p)))


# Groups of elements; an element outside all of them has the number behind the last.
GROUPS = (
    ("H", "C", "N", "O", "P", "S"),
    ("Li", "Na", "K", "Rb", "Cs", "Fr"),
    ("Be", "Mg", "Ca", "Sr", "Ba", "Ra"),
    ("Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Rf", "Db", "Sg", "Hs", "Mt", "Ds", "Rg", "Cn"),
    ("Al", "Ga", "In", "Sn", "Tl", "Pb", "Bi", "Nh", "Fl", "Mc", "Lv"),
    ("B", "Si", "Ge", "As", "Sb", "Te", "Po"),
    ("F", "Cl", "Br", "I", "At", "Ts"),
    ("He", "Ne", "Ar", "Kr", "Xe", "Rn", "Og"),
    ("La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu"),
    ("Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr"),
)


def ring_bonds(n: int, bonds: list[tuple[int, int, str]]) -> set[int]:
    """The bonds (by number) that lie on a ring: those whose ends stay connected without them."""
    found = set()
    for k, (a, b, _) in enumerate(bonds):
        near: dict[int, list[int]] = {}
        for j, (x, y, _) in enumerate(bonds):
            if j != k:
                near.setdefault(x, []).append(y)
                near.setdefault(y, []).append(x)
        seen, stack = {a}, [a]
        while stack:
            for y in near.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        if b in seen:
            found.add(k)
    return found


def graph(text: str | None) -> dict | None:
    """Atoms and directed edges of a molecule; null if its grammar is broken.

    Per atom: element (its number in COMMON from 1, 0 for others), group, charge, aromatic, hydrogens, degree
    and ring. A virtual last atom of zeros is joined to all others. Edges go both ways, with kind 1 to 4 for
    single, double, triple and aromatic bonds, 0 for virtual ones, and ring. A molecule without bonds has
    one edge of its first atom to itself.
    """
    found = parse(text) if text else None
    if not found:
        return None
    atoms, bonds = found
    n, kinds = len(atoms), "-=#:"
    rings = ring_bonds(n, bonds)
    ends = [e for a, b, _ in bonds for e in (a, b)]
    in_ring = {e for k in rings for e in bonds[k][:2]}
    group = lambda s: next((i for i, g in enumerate(GROUPS) if s in g), len(GROUPS))
    edges = [(i, j, kinds.find(kind) + 1, int(k in rings)) for k, (a, b, kind) in enumerate(bonds) for i, j in ((a, b), (b, a))]
    edges = edges + [(i, j, 0, 0) for a in range(n) for i, j in ((a, n), (n, a))] if edges else [(0, 0, 0, 0)]
    return {
        "x": [COMMON.index(a["symbol"]) + 1 if a["symbol"] in COMMON else 0 for a in atoms] + [0],
        "group": [group(a["symbol"]) for a in atoms] + [0],
        "charge": [a["charge"] for a in atoms] + [0],
        "aromatic": [int(a["aromatic"]) for a in atoms] + [0],
        "hydrogens": [a["hydrogens"] or 0 for a in atoms] + [0],
        "degree": [ends.count(i) for i in range(n)] + [0],
        "ring": [int(i in in_ring) for i in range(n)] + [0],
        "src": [e[0] for e in edges],
        "dst": [e[1] for e in edges],
        "kind": [e[2] for e in edges],
        "ring_edge": [e[3] for e in edges],
    }


GRAPH = "struct<" + ",".join(f"{c}:array<int>" for c in ("x", "group", "charge", "aromatic", "hydrogens", "degree", "ring", "src", "dst", "kind", "ring_edge")) + ">"


def map_distinct(df: DataFrame, key: str, fn: Callable[[str], object], out: str, kind: str) -> DataFrame:
    """df with out = fn(key), computed once per distinct non-null key in Arrow batches; null for null."""
    run = F.udf(fn, kind, useArrow=True)
    lookup = df.select(F.col(key).alias("__key")).where("__key is not null").distinct().withColumn("__value", run("__key"))
    return df.join(lookup, F.col(key) == F.col("__key"), "left").withColumn(out, F.col("__value")).drop("__key", "__value")


def validate(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "Issues") -> DataFrame:
    return map_distinct(df, smiles_col, issue, out_col, "string")


def _valid_else_null(df: DataFrame, smiles_col: str, out_col: str, value: Column) -> DataFrame:
    checked = validate(df, smiles_col, "__issue")
    return checked.withColumn(out_col, F.when(F.col("__issue") == "", value)).drop("__issue")


def filter_inorganic(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "Filtered") -> DataFrame:
    """Adds the string where it has a carbon atom, else null. Rows stay."""
    s = F.col(smiles_col)
    return _valid_else_null(df, smiles_col, out_col, F.when(F.array_contains(symbols(s), "C"), s))


def filter_uncommon(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "Filtered") -> DataFrame:
    """Adds the string where all its elements are in ALLOWED, else null."""
    s = F.col(smiles_col)
    return _valid_else_null(df, smiles_col, out_col, F.when(F.size(F.array_except(symbols(s), _among(ALLOWED))) == 0, s))


def flag_organometallics(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "Organometallics") -> DataFrame:
    """Adds the metals of METALS that occur, sorted and joined by " | "; empty if none, null if invalid."""
    return _valid_else_null(df, smiles_col, out_col, F.array_join(F.array_intersect(symbols(F.col(smiles_col)), _among(METALS)), " | "))


def flag_uncommon(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "Uncommon") -> DataFrame:
    """Adds the elements outside COMMON, sorted and joined by " | "."""
    return _valid_else_null(df, smiles_col, out_col, F.array_join(F.array_except(symbols(F.col(smiles_col)), _among(COMMON)), " | "))


def remove_minor(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "CanSMILES") -> DataFrame:
    return map_distinct(df, smiles_col, largest_fragment, out_col, "string")


def strip_stereo(smiles: Column) -> Column:
    """The string without stereo marks; its atoms and bonds stay as written."""
    return F.regexp_replace(smiles, r"[@/\\]", "")


def molecule_graph(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "graph") -> DataFrame:
    return map_distinct(df, smiles_col, graph, out_col, GRAPH)


def within_bounds(properties: dict[str, str], bounds: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """(kept, message) of property columns against inclusive bounds; a null property is outside.

    The message lists violations as "Name: 1.23 < lo", joined by " | "; null if there are none.
    """
    notes = []
    for name, (lo, hi) in bounds.items():
        v = F.col(properties[name]).cast("double")
        notes.append(F.when(v.isNull(), F.lit(f"{name}: missing")).when(v < lo, F.format_string(f"{name}: %.2f < {lo:g}", v)).when(v > hi, F.format_string(f"{name}: %.2f > {hi:g}", v)))
    found = F.filter(F.array(*notes), lambda x: x.isNotNull())
    return F.size(found) == 0, F.when(F.size(found) > 0, F.array_join(found, " | "))


_toolkits: dict[str, tuple[Callable[[str], object], str]] = {}
#: Key transforms that this library names but leaves to a toolkit.
TOOLKIT_STEPS = ("normalize", "disconnect_metals", "strip_salts", "remove_stereochemistry", "remove_charges", "enumerate_tautomers", "ecfp", "daylight", "atompair", "maccs", "klek", "rdkit", "common_rdkit", "chemberta", "mapc", "mordred", "cddd", "murcko", "embed", "dock")


def register_key_transform(name: str, fn: Callable[[str], object], kind: str) -> None:
    """Provide a toolkit function of one key; kind is the Spark type of its result."""
    _toolkits[name] = (fn, kind)


def key_transform(df: DataFrame, name: str, key: str = "SMILES", out: str | None = None) -> DataFrame:
    """df with the registered transform of each distinct key. A key that fails gives null for itself alone."""
    if name not in _toolkits:
        raise MissingToolkit(f"{name}: register_key_transform() has not been given a function")
    fn, kind = _toolkits[name]

    def safe(k: str):
        try:
            return fn(k)
        except Exception:  # noqa: BLE001
            return None

    return map_distinct(df, key, safe, out or name, kind)


#: The order of standardization.
CLEANING = ("normalize", "disconnect_metals", "strip_salts", "remove_minor", "remove_stereochemistry", "remove_charges", "enumerate_tautomers")


def pipeline_clean(df: DataFrame, smiles_col: str = "SMILES", out_col: str = "CanSMILES") -> DataFrame:
    """The cleaning steps in order, each on the result of the one before; nulls stay null."""
    now = df.withColumn(out_col, F.col(smiles_col))
    for step in CLEANING:
        now = remove_minor(now, out_col, "__next") if step == "remove_minor" and step not in _toolkits else key_transform(now, step, out_col, "__next")
        now = now.withColumn(out_col, F.col("__next")).drop("__next")
    return now
