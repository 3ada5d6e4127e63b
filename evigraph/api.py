"""The analysis queries over HTTP, on the standard library's server. Every response reads one pinned snapshot."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from .operators import graph
from .operators.store import Snapshots

RENAMED = {"source_node_id": "source", "target_node_id": "target"}


class Bad(Exception):
    """An answer that is an error."""

    def __init__(self, status: int, code: str, message: str, **extra):  # type: ignore[no-untyped-def]
        super().__init__(message)
        self.status, self.code, self.extra = status, code, extra


def _number(query: dict, name: str, default, least, most=None, kind=int):  # type: ignore[no-untyped-def]
    try:
        value = kind(query.get(name, default))
    except ValueError:
        raise Bad(422, "invalid_request", f"{name} must be a number") from None
    if value < least or (most is not None and value > most):
        raise Bad(422, "invalid_request", f"{name} must be from {least}" + f" to {most}" * (most is not None))
    return value


def _time(text: str | None) -> datetime:
    try:
        when = datetime.fromisoformat((text or "").replace(" ", "+"))
    except ValueError:
        raise Bad(422, "invalid_request", "since must be an ISO 8601 time; write + as %2B") from None
    if when.tzinfo is None:
        raise Bad(422, "invalid_request", "since must have a time zone")
    return when.astimezone(UTC)


class Service:
    """Paths to answers, without the server: `answer(path)` gives (status, body)."""

    def __init__(self, store: Snapshots, min_delta: int = 3, min_ratio: float = 0.5, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.store, self.growth, self.now = store, (min_delta, min_ratio), now

    def network(self, s: Snapshots, name: str, q: dict) -> dict:
        """A1."""
        depth = _number(q, "depth", 2, 1, 2)
        most = _number(q, "max_nodes", graph.MAX_NODES, 1, graph.MAX_NODES), _number(q, "max_edges", graph.MAX_EDGES, 1, graph.MAX_EDGES)
        own = _number(q, "entity_id", 0, 1) if "entity_id" in q else None
        nodes, edges = s.read("nodes"), s.read("edges").withColumnsRenamed(RENAMED)
        root = graph.resolve_entity(nodes, s.read("node_aliases"), name, own)
        found, links, meta = graph.network(nodes, edges, root["id"], depth, *most)
        one = lambda r: {"id": str(r.id), "name": r["name"], "entity_type": r.entity_type, "mention_count": r.mention_count}
        return {
            "root": {**{k: root[k] for k in ("name", "entity_type", "mention_count")}, "id": str(root["id"])},
            "nodes": [{**one(r), "distance": r.distance} for r in found.orderBy("place").collect()],
            "edges": [{"id": str(r.id), "source": str(r.source), "target": str(r.target), **{c: r[c] for c in ("relation_type", "directed", "weight", "first_seen", "last_seen")}} for r in links.orderBy("id").collect()],
            **{k: v for k, v in meta.items() if k != "root_id"},
        }

    def connections(self, s: Snapshots, q: dict) -> dict:
        """A2."""
        delta, ratio = _number(q, "min_delta", self.growth[0], 1), _number(q, "min_ratio", self.growth[1], 1e-12, kind=float)
        limit, offset = _number(q, "limit", 20, 1, graph.MAX_PAGE), _number(q, "offset", 0, 0, graph.MAX_OFFSET)
        since, as_of = _time(q.get("since")), self.now()
        if since > as_of:
            raise Bad(422, "invalid_request", "since must not be in the future")
        ev = s.read("edge_sources").join(s.read("sources").select(F.col("id").alias("source_id"), "source_url"), "source_id")
        return graph.connections(ev, s.read("edges").withColumnsRenamed(RENAMED), s.read("nodes"), since, as_of, delta, str(ratio), limit, offset)

    def central(self, s: Snapshots, q: dict) -> dict:
        """A3."""
        limit, offset = _number(q, "limit", 20, 1, graph.MAX_PAGE), _number(q, "offset", 0, 0, graph.MAX_OFFSET)
        nodes = s.read("nodes")
        rows = graph.central_page(nodes, s.read("edges").withColumnsRenamed(RENAMED), limit, offset).orderBy("rank").collect()
        items = [{"rank": r.rank, "id": str(r.id), "name": r["name"], **{c: r[c] for c in ("entity_type", "score", "degree", "relation_type_count", "weighted_degree", "mention_count")}} for r in rows]
        total = nodes.count()
        return {"metric": "normalized_degree", "node_count": total, "items": items, "total": total, "limit": limit, "offset": offset}

    def citations(self, s: Snapshots, edge: str, q: dict) -> dict:
        """A4."""
        limit, offset = _number(q, "limit", 20, 1, graph.MAX_PAGE), _number(q, "offset", 0, 0, graph.MAX_OFFSET)
        own = _number({"edge_id": edge}, "edge_id", 0, 1)
        return graph.citations(s.read("edges").withColumnsRenamed(RENAMED), s.read("nodes"), s.read("edge_sources"), s.read("sources"), own, limit, offset)

    def health(self, s: Snapshots) -> dict:
        """A5."""
        counts = graph.graph_counts(nodes=s.read("nodes"), edges=s.read("edges"), sources=s.read("sources"), evidence=s.read("edge_sources"))
        return {"status": "ok", "schema_version": s.meta().schema_version, "graph": {r["name"]: r.value for r in counts.collect()}}

    def answer(self, target: str, method: str = "GET") -> tuple[int, dict]:
        parts = urlsplit(target)
        q = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
        path = [unquote(x) for x in parts.path.strip("/").split("/")]
        try:
            if method != "GET":
                raise Bad(405, "method_not_allowed", "only GET is answered")
            s = self.store.pinned()
            if not s.version:
                raise Bad(503, "database_unavailable", "no snapshot is published yet")
            if path[0] == "entity" and path[-1] == "network" and len(path) > 2:
                return 200, self.network(s, "/".join(path[1:-1]), q)
            if path == ["connections", "new"]:
                return 200, self.connections(s, q)
            if path == ["entities", "central"]:
                return 200, self.central(s, q)
            if len(path) == 3 and path[0] == "edges" and path[2] == "sources":
                return 200, self.citations(s, path[1], q)
            if path == ["health"]:
                return 200, self.health(s)
            raise Bad(404, "not_found", f"nothing is at {parts.path}")
        except Bad as e:
            return self.error(e.status, e.code, str(e), **e.extra)
        except graph.AmbiguousEntity as e:
            return self.error(409, e.code, str(e), candidates=[{"id": str(c["id"]), **{k: c[k] for k in ("name", "entity_type", "mention_count")}} for c in e.candidates])
        except (graph.EntityNotFound, graph.EdgeNotFound) as e:
            return self.error(404, e.code, str(e))
        except RuntimeError as e:
            return self.error(503, "database_unavailable", str(e))

    @staticmethod
    def error(status: int, code: str, message: str, **extra) -> tuple[int, dict]:  # type: ignore[no-untyped-def]
        """A6."""
        return status, {"error": {"code": code, "message": message, "request_id": uuid.uuid4().hex, **extra}}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = service.answer(self.path, self.command)
            data = json.dumps(body, ensure_ascii=False, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Request-ID", body.get("error", {}).get("request_id", uuid.uuid4().hex))
            self.end_headers()
            self.wfile.write(data)

        do_POST = do_PUT = do_DELETE = do_PATCH = do_GET

        def log_message(self, *args) -> None:  # type: ignore[no-untyped-def]
            return

    return ThreadingHTTPServer((host, port), Handler)
