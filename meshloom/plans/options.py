"""Options of a run, checks of a tool's parameters, and the line-by-line service that answers requests with the tools."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

OUTPUTS = ("step", "summary", "topology", "report", "heatmap")
#: Other names of an output, and names of several. Fixed values.
SYNONYMS = {"cad": "step", "3d": "step", "json": "summary", "features": "summary", "mesh": "topology", "verify": "report", "glb": "heatmap"}
SETS = {"all": OUTPUTS, "standard": ("step", "summary", "report"), "default": ("step", "summary", "report"), "minimal": ("step",), "step-only": ("step",)}
REPRESENTATIONS = ("auto", "faceted", "tessellated")
HEATMAPS = ("failed-only", "always", "none")
#: Facets beyond which `auto` writes a tessellated body.
MANY_FACETS = 250_000


def outputs(text: str) -> frozenset[str]:
    """The outputs that a comma-separated text names, in any case; names that are none are left out."""
    found: set[str] = set()
    for word in (w.strip().lower() for w in text.split(",")):
        found |= set(SETS.get(word, ())) | ({SYNONYMS.get(word, word)} & set(OUTPUTS))
    return frozenset(found)


@dataclass(frozen=True)
class Options:
    """What a conversion is asked for. A value that is none of the allowed ones is a ValueError that names them."""

    out: str | None = None
    emit: frozenset[str] = field(default_factory=lambda: outputs("standard"))
    tier: str = "8k"
    representation: str = "auto"
    heatmap: str = "failed-only"
    material: str = "auto"
    simplify_to: float | int | None = None
    y_up: bool = False

    def __post_init__(self) -> None:
        from meshloom.operators.reports import TIERS

        for name, allowed in (("representation", REPRESENTATIONS), ("heatmap", HEATMAPS), ("tier", tuple(TIERS))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        if self.simplify_to is not None and not self.simplify_to > 0:
            raise ValueError("simplify_to must be positive")

    def kind(self, facets: int) -> str:
        """How a body of so many facets is written."""
        return ("tessellated" if facets > MANY_FACETS else "faceted") if self.representation == "auto" else self.representation


def base_name(path: str) -> str:
    """A path's last part without its extension."""
    return PurePosixPath(path).stem


def watchdog_seconds(mib: float) -> float:
    """How long a file of that size may take."""
    return min(300.0, 45.0 + 2.5 * mib)


#: name, what it does, required and further parameters
TOOLS = [
    ("analyze", "Counts, watertightness, bounds and shells of a mesh file.", ("path",), ()),
    ("threads", "Bores of a mesh file and the metric threads that fit them.", ("path",), ()),
    ("verify", "Five gates over a mesh file.", ("path",), ("out",)),
    ("convert", "Exchange file and documents of a mesh file.", ("path", "out"), ("tier", "emit")),
]


def manifest() -> list[dict]:
    """The tools with a schema of their parameters."""
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {p: {"type": "string"} for p in (*need, *more)}, "required": list(need)}} for n, d, need, more in TOOLS]


def checked(tool: str, parameters: object) -> dict[str, str]:
    """A tool's parameters, or a ValueError that says what is wrong with them."""
    found = next((t for t in TOOLS if t[0] == tool), None)
    if found is None:
        raise ValueError(f"no tool is named {tool!r}")
    if not isinstance(parameters, dict):
        raise ValueError("parameters must be an object")
    _, _, need, more = found
    for p in need:
        if not isinstance(parameters.get(p), str) or not parameters[p].strip():
            raise ValueError(f"{p} must be a text that is not empty")
    if unknown := sorted(set(parameters) - {*need, *more}):
        raise ValueError(f"{tool} takes no {', '.join(unknown)}")
    if "tier" in parameters:
        Options(tier=parameters["tier"])
    return {k: str(v) for k, v in parameters.items()}


def answer(line: str, call: Callable[[str, dict[str, str]], object]) -> dict | None:
    """The reply to one JSON-RPC request; None for a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
    if not isinstance(request, dict) or request.get("id") is None:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    method, given = request.get("method"), request.get("params") or {}
    if method == "ping":
        return reply | {"result": {}}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "meshloom", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": manifest()}}
    if method == "tools/call":
        try:
            out = call(given.get("name"), checked(given.get("name"), given.get("arguments")))
            return reply | {"result": {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out)}]}}
        except Exception as e:  # a failed call is a reply, and the service goes on
            return reply | {"result": {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}]}}
    return reply | {"error": {"code": -32601, "message": f"no method is named {method!r}"}}


def serve(lines: Iterable[str], call: Callable[[str, dict[str, str]], object], send: Callable[[str], object]) -> None:
    """Answers requests, one a line."""
    for line in lines:
        if line.strip() and (reply := answer(line, call)) is not None:
            send(json.dumps(reply) + "\n")
