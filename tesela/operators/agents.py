"""Annotation agents: their order, what they read, and a provider for the model behind them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIDENCE = ("alta", "media", "baja")
ANNOTATION = "agent string, trait string, quote string, confidence string"


def run_order(agents: list[dict]) -> list[str]:
    """Agents so that each comes after those whose categories it reads; of several that may come the least name first."""
    names = {a["name"] for a in agents}
    needs = {a["name"]: {d for d in a.get("disc_cats", []) if d in names and d != a["name"]} for a in agents}
    out: list[str] = []
    while needs:
        ready = sorted(n for n, d in needs.items() if d <= set(out))
        if not ready:
            raise ValueError(f"agents wait for one another: {sorted(needs)}")
        out.append(ready[0])
        del needs[ready[0]]
    return out


def summary_text(rows: list[tuple[str, str, str, int]], most: int = 3000) -> str:
    """Lines "family · attribute: value (n), …" of feature counts, whole lines up to ``most`` characters."""
    grouped: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for family, key, value, n in rows:
        grouped.setdefault((family, key), []).append((-n, value))
    out, size = [], 0
    for (family, key), values in sorted(grouped.items()):
        line = f"{family} · {key}: " + ", ".join(f"{v} ({-n})" for n, v in sorted(values)[:10])
        if size + len(line) + 1 > most:
            break
        out.append(line)
        size += len(line) + 1
    return "\n".join(out)


def prompt(agent: dict, summary: str, text: str, previous: str = "") -> str:
    """What an agent's model is asked."""
    parts = [agent.get("role", ""), agent.get("instructions", ""), "Esquema: " + json.dumps(agent.get("json_schema", {}), ensure_ascii=False)]
    parts += [f"Ejemplo: {json.dumps(e, ensure_ascii=False)}" for e in agent.get("few_shot_examples", [])]
    parts += [f"Gramática:\n{summary}" if summary else "", f"Anotaciones previas:\n{previous}" if previous else "", f"Texto:\n{text}"]
    return "\n\n".join(p for p in parts if p)


def parse_answer(answer: str | None) -> list[dict]:
    """Annotations of a model's answer: the outermost JSON list or object, mended if cut off; unknown confidences are ``baja``."""
    text = answer or ""
    m = re.search(r"[\[{]", text)
    if not m:
        return []
    body = text[m.start() :]
    for end in [*range(len(body), 0, -1)][:2000]:
        candidate = body[:end].rstrip().rstrip(",")
        closers = "".join("]" if c == "[" else "}" for c in reversed(_open(candidate)))
        try:
            found = json.loads(candidate + closers)
            break
        except ValueError:
            continue
    else:
        return []
    rows = found.get("anotaciones", [found]) if isinstance(found, dict) else found
    return [
        {"trait": r.get("trait"), "quote": r.get("quote"), "confidence": r.get("confidence") if r.get("confidence") in CONFIDENCE else "baja"}
        for r in rows if isinstance(r, dict) and r.get("trait") and r.get("quote")
    ]


def _open(text: str) -> list[str]:
    stack, quoted, escaped = [], False, False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            stack.append(c)
        elif not quoted and c in "]}" and stack:
            stack.pop()
    return stack


def no_model(question: str) -> str:
    """The provider where there is no model: no annotations."""
    return "[]"


def annotate(documents: DataFrame, agent: dict, doc: str, text: str, provider: Callable[[str], str] = no_model, tries: int = 4, most: int = 300_000) -> DataFrame:
    """doc, agent, trait, quote, confidence: the agent's annotations, documents in batches, each asked up to ``tries`` times."""
    name = agent["name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, value in zip(batch[doc], batch[text]):
                for attempt in range(tries):
                    try:
                        rows += [(key, name, r["trait"], r["quote"], r["confidence"]) for r in parse_answer(provider(prompt(agent, "", (value or "")[:most])))]
                        break
                    except OSError:
                        if attempt == tries - 1:
                            raise
            yield pd.DataFrame(rows, columns=[doc, "agent", "trait", "quote", "confidence"])

    kind = dict(documents.dtypes)[doc]
    return documents.select(doc, text).mapInPandas(run, f"`{doc}` {kind}, {ANNOTATION}")


def previous_annotations(annotations: DataFrame, agent: dict) -> DataFrame:
    """Annotations of the agents that this one reads."""
    return annotations.where(F.col("agent").isin(list(agent.get("disc_cats", [])) or [""]))


def annotation_stats(annotations: DataFrame) -> DataFrame:
    """Annotations, located ones and their mean length by agent and trait."""
    located = F.col("start_char") >= 0
    return annotations.groupBy("agent", "trait").agg(F.count(F.lit(1)).alias("n"), F.count_if(located).alias("localizadas"), F.avg(F.when(located, F.col("end_char") - F.col("start_char"))).alias("largo_medio"))
