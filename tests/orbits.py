"""Small source pairs for the tests."""

SCHEMA = "id string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question string, question_decomposition array<struct<id:int,question:string,answer:string,paragraph_support_idx:int>>, answer string, answer_aliases array<string>, answerable boolean"
WORDS = "river stone cloud amber field lantern copper meadow signal harbor violet timber canyon engine marble".split()


def paragraphs(name, support, text=None, n=20):
    def body(i):
        if i in support:
            return (text or f"{name} evidence {i} with bridge{name} and goal{name} inside") + f" {i}"
        k = sum(map(ord, name)) + i
        return " ".join(WORDS[(k * (j + 3)) % len(WORDS)] + str((k + j) % 7) for j in range(8 + k % 4)) + f" {name} {i}"

    return [{"idx": i, "title": f"Title {WORDS[(sum(map(ord, name)) + i) % len(WORDS)]} {i}", "paragraph_text": body(i), "is_supporting": i in support} for i in range(n)]


def pair(name, aliases=(), missing_aliases=None, answer=None, **change):
    """The complete and the missing row of one id."""
    goal = answer or f"goal{name}"
    steps = [{"id": 1000, "question": "first?", "answer": f"bridge{name}", "paragraph_support_idx": 0}, {"id": 2000, "question": "then?", "answer": goal, "paragraph_support_idx": 1}]
    full = {"id": name, "paragraphs": paragraphs(name, (0, 1)), "question": f"Which stone lies by {name}?", "question_decomposition": steps, "answer": goal, "answer_aliases": list(aliases), "answerable": True}
    gone = [dict(p) for p in full["paragraphs"]]
    gone[1] = {"idx": 1, "title": "Title other", "paragraph_text": f"nothing here {name}", "is_supporting": False}
    gone[0] = dict(gone[0], paragraph_text=f"{name} evidence 0 with bridge{name} inside 0")
    lost = full | {"paragraphs": gone, "question_decomposition": [steps[0], steps[1] | {"paragraph_support_idx": None}], "answer_aliases": list(aliases if missing_aliases is None else missing_aliases), "answerable": False}
    return [full, lost | change]
