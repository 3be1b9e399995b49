"""What a model is told for each kind of request. The first line names the task; the rest says what the reply holds."""

from __future__ import annotations

#: Changes whenever an instruction does, so that no cached reply outlives the words it answered.
PROMPT_VERSION = "2"
TYPES = "topic, concept, definition, example, insight, action, warning, question or detail"
REPLIES = {
    "map": 'One part of a source. Reply {"topic": its subject, "type": ' + TYPES + ', "summary": two sentences at most, "points": [{"title": ..., "type": ...}]}.',
    "map_batch": 'Several parts, each with an id. Reply {"results": [{"id": ..., and for each part what a single part gets: topic, type, summary, points}]}.',
    "reduce": 'The parts of a source in order. Reply one tree {"central": its name, "children": [{"title", "type", "note", "t": seconds, "children": [...]}]}.',
    "headings": 'Sections that the author numbered aloud. Reply {"headings": [one short, parallel heading for each, in order]}.',
    "section": 'One section whose title is fixed. Reply {"note": what it claims, "points": [{"title", "type"}]}.',
    "anchors": 'Numbered nodes, and candidates that the source names but the map lacks. Reply {"repairs": [{"to": node id, "title", "type"}]} for those that matter.',
    "synthesis": 'A whole map. Reply {"takeaways": [{"title", "note", "type"}]}: what holds across its sections.',
    "link": 'Numbered nodes with their sections. Reply {"relationships": [{"from": id, "to": id, "label"}]} that the tree itself does not show.',
    "label": 'A folder and what lies in it. Reply {"label": its purpose in one line}.',
}
LEVELS = {"brief": "Main branches only, nothing below them.", "full": "Branches with their main points.", "expert": "Branches, points and the detail that an expert would miss."}
PURPOSES = {
    "general": "", "study": "The reader wants to learn and be tested: prefer definitions, examples and questions.",
    "work": "The reader wants to act: prefer decisions, actions and warnings.", "research": "The reader wants evidence: prefer claims, figures and open questions.",
}


def system(task: str, level: str = "full", purpose: str = "general", limit: int | None = None) -> str:
    """The instruction for a task; limit bounds how many results are asked for, which a model may ignore."""
    if task not in REPLIES:
        raise ValueError(f"no such task: {task}")
    lines = [f"TASK: {task}", REPLIES[task], LEVELS.get(level, LEVELS["full"]), PURPOSES.get(purpose, ""), f"At most {limit}." if limit else "", "Reply with JSON alone."]
    return "\n".join(x for x in lines if x)
