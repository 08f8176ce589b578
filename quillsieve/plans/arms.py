"""Arm specifications: [label=]name[:argument], with sent+, fill+ and rrf:a|b composing other arms."""

from __future__ import annotations

from dataclasses import dataclass, field

CHUNK = frozenset({"lead", "random", "bm25", "embed", "reranker", "oracle_span", "oracle_support", "oracle_beta", "pruner", "provence"})
SENTENCE = frozenset({"recomp", "exit"})
TEXT = frozenset({"llmlingua", "longllmlingua", "llmlingua2", "llmlingua_tt", "longllmlingua_tt"})
#: Arms that no wrapper may rescore.
FIXED = frozenset({"lead", "random", "oracle_span", "oracle_support", "oracle_beta", "full"})


@dataclass(frozen=True)
class Arm:
    label: str
    kind: str  # full, chunk, sentence, fill or text
    name: str
    argument: str | None = None
    parts: tuple[Arm, ...] = field(default_factory=tuple)

    def models(self) -> list[str]:
        """What must be loaded for it: itself or its parts, without those that need nothing."""
        own = [] if self.parts or self.name in ("lead", "random", "bm25", "full", "oracle_span", "oracle_support", "oracle_beta") else [f"{self.name}:{self.argument}" if self.argument else self.name]
        return own + [m for p in self.parts for m in p.models()]


def parse(spec: str) -> Arm:
    head, eq, rest = spec.partition("=")
    label, body = (head, rest) if eq and "+" not in head and ":" not in head else (spec, spec)
    for prefix, kind in (("sent+", "sentence"), ("fill+", "fill")):
        if body.startswith(prefix):
            inner = parse(body[len(prefix) :])
            if inner.kind != "chunk" or inner.name in FIXED:
                raise ValueError(f"{prefix} can't wrap {inner.name}")
            return Arm(label, kind, prefix[:-1], None, (inner,))
    name, colon, argument = body.partition(":")
    if name == "rrf":
        parts = tuple(parse(p) for p in argument.split("|"))
        if len(parts) < 2 or any(p.kind != "chunk" or p.name in FIXED for p in parts):
            raise ValueError(f"rank fusion takes two or more model arms: {spec}")
        return Arm(label, "chunk", "rrf", None, parts)
    kind = "full" if name == "full" else "chunk" if name in CHUNK else "sentence" if name in SENTENCE else "text" if name in TEXT else None
    if kind is None:
        raise ValueError(f"unknown arm: {spec}")
    if name == "pruner" and not argument:
        raise ValueError("pruner takes a path")
    return Arm(label, kind, name, argument if colon else None)


def parse_all(specs: list[str]) -> list[Arm]:
    arms = [parse(s) for s in specs]
    if len({a.label for a in arms}) < len(arms):
        raise ValueError("arms with one label")
    return arms
