"""Queries of the operators, with SQL where SQL can express them."""

from graphloom.llm import bm25, divergence, epsilon_grid, forest, langid, mixing, phrases, repair, sentencepiece_backend, suffix_array, toolcalls, transducer, warc


def pipeline(spark, sf_dir):
    """The stages of ``corpus_pipeline.py`` at the top of the repository, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_warc_salvage": warc.op1_warc_salvage,
        "op2_suffix_array_dedup": suffix_array.op2_suffix_array_dedup,
        "op3_substring_dedup": phrases.op3_substring_dedup,
        "op4_ngram_jaccard_join": forest.op4_ngram_jaccard_join,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_tool_call_linking": toolcalls.op6_tool_call_linking,
        "op7_embedding_near_dedup": epsilon_grid.op7_embedding_near_dedup,
        "op8_sentencepiece": sentencepiece_backend.op8_sentencepiece,
        "op9_language_id": langid.op9_language_id,
        "op10_bm25_topk": bm25.op10_bm25_topk,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_token_counts": transducer.op12_token_counts,
        "op13_source_divergence": divergence.op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op1_warc_salvage": warc.OP1_SQL, "op7_embedding_near_dedup": epsilon_grid.OP7_SQL, "op13_source_divergence": divergence.OP13_SQL}
