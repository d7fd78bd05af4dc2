"""The service over HTTP as a WSGI application, with errors as statuses."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable
from http import HTTPStatus
from urllib.parse import parse_qs

from quern.plans.service import Engine, ServiceError

log = logging.getLogger(__name__)


def application(engine: Engine) -> Callable[[dict, Callable], Iterable[bytes]]:
    """GET /health, GET /documents?limit=&offset=, POST /documents (a list of {filename, content}), POST /query."""

    def health(_: dict, __: dict) -> tuple[int, dict]:
        state = engine.health()
        return (200 if state["status"] == "ok" else 503), state

    def listing(_: dict, query: dict) -> tuple[int, dict]:
        page = engine.documents(int(query.get("limit", ["100"])[0]), int(query.get("offset", ["0"])[0]))
        return 200, {"documents": [r.asDict() for r in page.collect()]}  # at most 1000 rows

    def upload(body: dict, _: dict) -> tuple[int, dict]:
        rows = engine.upload([(f["filename"], f["content"].encode()) for f in body["files"]])
        return 200, {"results": [r.asDict() for r in rows.collect()]}  # at most UPLOAD_FILES rows

    def query(body: dict, _: dict) -> tuple[int, dict]:
        known = {k: body[k] for k in ("strategy", "top_k", "filters") if body.get(k) is not None}
        return 200, engine.query(body["query"], with_text=bool(body.get("include_context_text")), **known)

    routes = {("GET", "/health"): health, ("GET", "/documents"): listing, ("POST", "/documents"): upload, ("POST", "/query"): query}

    def respond(environ: dict, start: Callable) -> Iterable[bytes]:
        at = environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO", "/").rstrip("/") or "/"
        try:
            if at not in routes:
                raise ServiceError(405 if any(p == at[1] for _, p in routes) else 404, "no such route")
            size = int(environ.get("CONTENT_LENGTH") or 0)
            body = json.loads(environ["wsgi.input"].read(size) or b"{}") if size else {}
            status, out = routes[at](body, parse_qs(environ.get("QUERY_STRING", "")))
        except ServiceError as e:
            log.warning("%s %s: %s", *at, e)
            status, out = e.status, {"detail": str(e)}
        except (ValueError, KeyError, TypeError) as e:
            status, out = 422, {"detail": str(e)}
        except Exception:
            log.exception("%s %s failed", *at)
            status, out = 500, {"detail": "internal error"}
        data = json.dumps(out, default=str).encode()
        start(f"{status} {HTTPStatus(status).phrase}", [("Content-Type", "application/json"), ("Content-Length", str(len(data)))])
        return [data]

    return respond
