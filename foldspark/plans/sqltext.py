"""Text pieces of the SQL oracles: the keyed hash and the derived views as CTEs."""

from __future__ import annotations

from ..functions.hashing import MIX, POISSON_CUTS, STRIDE, WORD, mix_int


def _fold(x: str) -> str:
    return f"xor({x}, ({x}) >> 16)"


def _turn(x: str) -> str:
    return f"(({_fold(x)} * {MIX}) % {WORD})"


def u32(seed, row_id: str) -> str:
    """Keyed hash text; ids of the oracle tables stay below 2^32."""
    if isinstance(seed, int):
        key = f"CAST({mix_int((seed * STRIDE + 1) % WORD)} AS BIGINT)"
    else:
        key = _fold(_turn(_turn(f"((CAST({seed} AS BIGINT) * {STRIDE} + 1) % {WORD})")))
    return _fold(_turn(_turn(f"xor({_turn(row_id)}, {key})")))


def u63(seed: str, row_id: str) -> str:
    hi, lo = u32(f"(({seed}) * 2)", row_id), u32(f"(({seed}) * 2 + 1)", row_id)
    return f"((({hi}) >> 1) * {WORD} + ({lo}))"


def u01(seed, row_id: str) -> str:
    return f"(CAST({u32(seed, row_id)} AS DOUBLE) / {WORD}.0::DOUBLE)"


def poisson1(u: str) -> str:
    return "(" + " + ".join(f"CAST({u} >= {c} AS BIGINT)" for c in POISSON_CUTS) + ")"


def rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


def with_views(*names: str, more: str = "") -> str:
    """WITH clause holding the named views, what they need, and further CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = VIEWS[name]
        for d in deps:
            add(d)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    if more:
        ctes.append(more)
    return "WITH " + ",\n".join(ctes) + "\n"
