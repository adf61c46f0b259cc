"""Garbled places beside marks, invisible characters and symbols."""

from quirel.llm import garbled


def test_garbled_places_count_whatever_else_the_text_holds(spark):
    clean = ["Le théâtre à côté du château a été fermé après la soirée."] * 30
    scores = garbled.PairScores(*garbled.pair_scores(spark.createDataFrame([(t,) for t in clean], "t string"), "t"))
    good, bad = "Le théâtre a été fermé.", "Le thÃ©Ã¢tre a été fermé."
    for rest in (" a\u200bb" * 30, " e\u0301" * 30, "\n│ → ± │" * 30, " ┼┼┼┼┼┼" * 30):
        assert garbled.repair_text(bad + rest, scores, {})[0] == good + rest
        assert garbled.repair_text(good + rest, scores, {})[2] == 0
    salad = "so¬±trto§¦.i¶l.lb¬±¤±sd°¬¢l¢s¬l ¦¬±.eins ¬¤§° ±¦÷ ¢¶± ÷a¬ ¦¶ ±±±¬ a¢b"
    assert garbled.repair_text(salad + " ¦ ¬ ± ¢ ¶ ¤ § ° ÷" * 20, scores, {})[2] == 0
