"""A small demo data set: an invented harbour town's services, with questions and graded labels."""

from __future__ import annotations

import json
from pathlib import Path

#: Title and text of each document.
DOCS = [
    ("Ferry timetable", "The Marlow ferry leaves Northquay at 06:40 and 17:15 on working days. A crossing takes 25 minutes. On Sundays only the 10:30 ferry runs."),
    ("Ferry fares", "A single crossing costs 4 crowns. A monthly pass costs 60 crowns. Children under 7 travel free of charge."),
    ("Harbour lighthouse", "The Tern Point lighthouse was built in 2009 to replace a wooden tower. Its lamp is seen from 18 miles away."),
    ("Town library", "The Alder Street library opens at nine and closes at six. Members may borrow 12 books for four weeks."),
    ("Library renewal", "In 2021 the Alder Street library opened a reading garden. The garden was paid for by the Rowan Fund."),
    ("Fish market", "The fish market is held on Wednesday and Saturday. Stalls sell cod, herring and mussels. Traders pay 15 crowns a stall."),
    ("Market rules", "The fish market moved from Mill Square to Northquay in 2018. Ice must be fresh every morning."),
    ("Cycle hire", "Bluewheel rents bicycles at Northquay and Mill Square. An hour costs 2 crowns, a day 9 crowns."),
    ("Cycle paths", "The coast path from Northquay to Tern Point is 11 kilometres long. Pathmaster counted 900 riders a day in 2022."),
    ("Water works", "The Brook Hill water works treat 30 million litres a day. The filters are changed every March."),
]
#: Question, answer, words expected in it, documents in order of relevance (numbers from 1), kind of question, difficulty.
QUESTIONS = [
    ("When does the Marlow ferry leave Northquay on working days?", "At 06:40 and 17:15.", ["06:40", "17:15"], [1], "direct_fact", "easy"),
    ("How much is a monthly ferry pass?", "60 crowns.", ["60 crowns"], [2, 1], "numeric_answer", "easy"),
    ("In which year was the Tern Point lighthouse built?", "2009.", ["2009"], [3], "date_or_timeline", "easy"),
    ("How many books may library members borrow?", "12 books for four weeks.", ["12"], [4], "numeric_answer", "easy"),
    ("Who paid for the reading garden of the library?", "The Rowan Fund.", ["Rowan Fund"], [5, 4], "direct_fact", "easy"),
    ("Which fish do the stalls sell?", "Cod, herring and mussels.", ["cod", "herring", "mussels"], [6], "list_answer", "easy"),
    ("Where was the fish market before 2018?", "On Mill Square.", ["Mill Square"], [7, 6], "multi_hop", "medium"),
    ("Compare Bluewheel and Marlow ferry by price", "An hour of cycling costs 2 crowns, a crossing 4 crowns.", ["2 crowns", "4 crowns"], [8, 2], "comparison", "medium"),
    ("How long is the coast path?", "11 kilometres.", ["11 kilometres"], [9], "numeric_answer", "easy"),
    ("Who is the mayor of the town?", None, [], [], "not_in_context", "easy"),
]


def _name(number: int) -> str:
    return f"doc_{number:03d}"


def write_demo(folder: str | Path = "data/demo", overwrite: bool = False) -> dict[str, int]:
    """Documents that are not there yet (or all, if ``overwrite``), and always the questions and labels: relevance 3 for the first relevant
    document and 2 for others. Returns counts."""
    root = Path(folder)
    (root / "docs").mkdir(parents=True, exist_ok=True)
    written, qrels, questions = 0, [], []
    for n, (title, text) in enumerate(DOCS, 1):
        path = root / "docs" / f"{_name(n)}.md"
        if overwrite or not path.exists():
            path.write_text(f"# {title}\n\n{text}\n", encoding="utf-8")
            written += 1
    for n, (question, answer, words, docs, category, difficulty) in enumerate(QUESTIONS, 1):
        answers = "unanswerable" if not docs else "list" if category == "list_answer" else "single_fact"
        questions.append({"id": f"q_{n:03d}", "question": question, "reference_answer": answer, "expected_keywords": words, "relevant_doc_ids": [_name(d) for d in docs], "category": category, "difficulty": difficulty, "answer_type": answers})
        qrels += [{"query_id": f"q_{n:03d}", "doc_id": _name(d), "relevance": 2 if at else 3} for at, d in enumerate(docs)]
    for name, rows in (("questions", questions), ("qrels", qrels)):
        (root / f"{name}.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return {"documents": len(DOCS), "questions": len(questions), "qrels": len(qrels), "written_docs": written}
