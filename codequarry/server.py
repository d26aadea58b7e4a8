"""The engine over HTTP, as JSON: ``python -m codequarry.cli serve``.

GET  /api/status               what is indexed
POST /api/index                {"repo": ..., "force": false}: starts a job (202)
GET  /api/index/progress/JOB   the job's state (404 if there is none)
POST /api/ask                  {"question": ..., "top_k": 8, "provider": ..., "model": ...} (400 without an index, 422 if the request is no good)
"""

from __future__ import annotations

import json
import logging
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans import answers

log = logging.getLogger(__name__)
MOST_BODY = 1 << 20


class Refused(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


def status(engine) -> dict:
    state = engine.status()
    last = str(state["last_indexed"])[:19] if state["last_indexed"] else None
    return state | {"last_indexed": last, "graph_present": engine.has_graph(), "store_path": engine.root, "embedding_provider": engine.settings.embedding_provider, "llm_provider": engine.settings.llm_provider}


def start_index(engine, body: dict) -> dict:
    if not isinstance(body.get("repo"), str) or not body["repo"].strip():
        raise Refused(422, "repo is missing")
    return {"job_id": engine.submit_index(body["repo"], not body.get("force", False)), "status": "started"}


def progress(engine, job: str) -> dict:
    try:
        return engine.progress(job)
    except KeyError:
        raise Refused(404, f"there is no job {job!r}") from None


def ask(engine, body: dict) -> dict:
    """An answer. A provider that needs a key and has none is replaced by the offline one."""
    if not isinstance(body.get("question"), str):
        raise Refused(422, "question is missing")
    if not engine.status()["indexed"]:
        raise Refused(400, "nothing is indexed yet")
    began, s = time.time(), engine.settings
    provider, model = body.get("provider") or s.llm_provider, body.get("model") or s.llm_model
    try:
        llm = answers.client_or_offline(provider, model, s)
        answer = engine.ask(body["question"], body.get("top_k"), 0, llm=llm)
    except (ValueError, TypeError) as e:
        raise Refused(422, str(e)) from e
    return {
        "answer": answer.answer, "citations": answer.citations, "context_chunks": answer.context_chunks, "provider": answer.provider, "model": answer.model,
        "total_tokens": answer.usage.total_tokens, "latency_seconds": round(time.time() - began, 3), "offline_mode": answer.provider == "offline",
    }


def handler(engine):
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, code: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _body(self) -> dict:
            size = int(self.headers.get("content-length") or 0)
            if size > MOST_BODY:
                raise Refused(413, "the request is too large")
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                raise Refused(422, "the request is not JSON") from None
            if not isinstance(body, dict):
                raise Refused(422, "the request is not an object")
            return body

        def _answer(self, method: str) -> None:
            path = self.path.partition("?")[0].rstrip("/")
            try:
                if (method, path) == ("GET", "/api/status"):
                    self._reply(200, status(engine))
                elif method == "GET" and path.startswith("/api/index/progress/"):
                    self._reply(200, progress(engine, path.rpartition("/")[2]))
                elif (method, path) == ("POST", "/api/index"):
                    self._reply(202, start_index(engine, self._body()))
                elif (method, path) == ("POST", "/api/ask"):
                    self._reply(200, ask(engine, self._body()))
                else:
                    raise Refused(404, "there is nothing here")
            except Refused as e:
                self._reply(e.status, {"detail": str(e)})
            except Exception as e:  # the server goes on
                log.exception("request failed")
                self._reply(500, {"detail": str(e)})

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, form: str, *values) -> None:
            log.info(form, *values)

    return Handler


def server(engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for the engine; ``serve_forever`` starts it."""
    return ThreadingHTTPServer((host, port), handler(engine))
