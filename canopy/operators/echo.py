"""A provider that answers with the request's own words: for tests, and for runs without a model."""

from __future__ import annotations

import json

from .requests import ProviderError


class EchoProvider:
    """The same request always gets the same reply; a request that holds fails_on fails."""

    def __init__(self, name: str = "echo", fails_on: str | None = None):
        self.name, self.model, self.fails_on = name, "echo-1", fails_on

    def complete_json(self, system: str, user: str) -> dict:
        if self.fails_on and self.fails_on in user:
            raise ProviderError(f"{self.name} refused")
        task = system.split("\n", 1)[0].removeprefix("TASK: ")
        return getattr(self, f"_{task}")(user if task == "map" else json.loads(user))

    def _map(self, text: str) -> dict:
        words = text.split()
        points = [{"title": " ".join(words[:2]), "type": "example"}, {"title": " ".join(words[2:4]), "type": "unheard of"}]
        return {"topic": " ".join(words[:3]), "type": "concept", "summary": " ".join(words[:12]), "points": points}

    def _map_batch(self, asked: dict) -> dict:
        return {"results": [{"id": s["id"], **self._map(s["text"])} for s in asked["segments"]]}

    def _reduce(self, asked: dict) -> dict:
        def branch(part: dict) -> dict:
            below = [{"title": "of " + part["topic"], "type": "detail"}]
            return {"title": part["topic"], "type": part["type"], "note": part["summary"], "children": [{**p, "children": below} for p in part["points"]]}

        return {"central": asked["segments"][0]["topic"], "children": ["no object", *map(branch, asked["segments"])]}

    def _headings(self, asked: list) -> dict:
        return {"headings": [f"Heading {s['number']}" if s["number"] % 2 else "" for s in asked]}

    def _section(self, asked: dict) -> dict:
        return {"note": " ".join(asked["transcript"].split()[:8]), "points": [{"title": asked["section_title"], "type": "insight"}, {"title": " "}, 7]}

    def _anchors(self, asked: dict) -> dict:
        return {"repairs": [{"to": i % len(asked["nodes"]), "title": c, "type": "example"} for i, c in enumerate(asked["candidates"])] + [{"to": -1, "title": "nowhere"}, {"title": "x"}]}

    def _synthesis(self, asked: dict) -> dict:
        return {"takeaways": [{"title": f"All of {asked['title']}", "note": str(len(asked["map"]))}, {"note": "without a title"}]}

    def _link(self, asked: list) -> dict:
        ends = {"from": 0, "to": len(asked) - 1}
        return {"relationships": [{**ends, "label": "first and last"}, {"from": ends["to"], "to": 0}, {"from": 1, "to": 1}, {"from": 0, "to": 10**6}]}

    def _label(self, asked: dict) -> dict:
        return {"label": f"{asked['folder']} with {len(asked['contents'])}"}
