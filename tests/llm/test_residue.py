import pytest

from sedimark.llm.residue import find_residue, judge, places, running, train

PROSE = [
    f"The {a} index of {b} is rebuilt every night, which keeps the second run under {n} seconds. We agreed to keep the threshold and to revisit it after the {a} rollout. {c}"
    for n, a in enumerate(["ledger", "ticket", "sensor", "route", "folder"])
    for b in ("north", "harbor", "cinder", "willow")
    for c in ("Nobody calls it any more.", "Deleting a file must also remove its vectors.", "Quand le cache est vide, la requête relit tout le projet.", "Después de borrar un archivo hay que quitar sus vectores.", "Access denied errors are logged once per session.")
]
MODELS = train(PROSE)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Lorem ipsum dolor amet magna aliqua tempor incididunt ut labore.", "filler"),
        ("site - Portal\n\n404 Not Found\n\nThe requested page /docs/x was not found on this server.", "notice"),
        ("Please enable JavaScript to view the ledger page.", "notice"),
        ("Su sesión ha caducado, vuelva a identificarse para abrir ledger.", "notice"),
        ("Content coming soon.\n\nCheck back later for the ledger section.", "filler"),
        (PROSE[0] + "\n\nOwner: [your name here]", "template"),
        (PROSE[1] + "\n\nDear $FIRST_NAME, the index is ready.", "template"),
        (PROSE[2] + "\n\nThe template shows `{{ user.name }}` because the pipe was removed.", None),
        (PROSE[3] + "\n\n```html\n<p>{{ label }}</p>\n[your name here]\n```", None),
        (PROSE[4] + '\n\nWe replaced the notice "Please enable JavaScript" by a table.', None),
        (PROSE[5], None), ("", None), (None, None), (" \n\t ", None), ("x" * 200_000, None), ("проверка индекса завершена", None),
    ],
)
def test_kinds(text, kind):
    assert judge([text], MODELS)[0][0] == kind


@pytest.mark.parametrize("line", ["[Insert diagram here]", "Reviewed by <REVIEWER NAME> on <DATE>.", "Due: YYYY-MM-DD", "Author: @@AUTHOR@@", "__MODULE_DESCRIPTION__", "<%= notes %>", "Version: ${project.version}", "Hello {user_name}, hi", "Contact: %TEAM_ALIAS%", "Impact: XXXX users", "[Insérer ici le schéma]", "[[ADD LINK TO page]]", "Replace this paragraph with a summary."])
def test_places(line):
    assert places(running(line))


@pytest.mark.parametrize("line", ["See [the guide](http://x.y/z) and [1].", "- [x] done", "[0][0][0]", "Use `${HOME}/cache` as the folder.", "A Map<string, number> holds it.", "<p class=\"x\">", "<|endoftext|>", "it costs $5 or 100%", 'Write "[insert name]" hints.', "call __init__ first"])
def test_no_places(line):
    assert not places(running(line))


def test_table(spark):
    rows = [(i, t, "s", 1.0) for i, t in enumerate(PROSE)] + [(900, "404 Not Found", "s", 1.0), (901, None, "s", 1.0), (902, "", None, 1.0), (903, "Owner: [your name here]", "s", None), (903, "Owner: [your name here]", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, share double")
    got = sorted((r.doc_id, r.kind) for r in find_residue(df).collect())
    assert got == [(900, "notice"), (903, "template"), (903, "template")]
    assert find_residue(df.limit(0)).count() == 0
