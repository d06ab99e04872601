"""Queries and oracle SQL of the training-data problems."""

from __future__ import annotations

from lectern.llm import abstracts, appearance, claims, corpus, duplicates, papers, people, professors


def queries():
    return {
        "p1_found": professors.p1_found, "p1_report": professors.p1_report, "p1_sample": professors.p1_sample,
        "p3_found": claims.p3_found, "p3_consensus": claims.p3_consensus, "p3_annotators": claims.p3_annotators,
        "p4_found": abstracts.p4_found, "p4_levels": abstracts.p4_levels, "p4_profile": abstracts.p4_profile,
        "p5_found": people.p5_found, "p5_people": people.p5_people,
        "p6_found": duplicates.p6_found, "p6_groups": duplicates.p6_groups,
        "p7_found": papers.p7_found, "p7_selected": papers.p7_selected,
        "p8_found": corpus.p8_found, "p8_packing": corpus.p8_packing, "p8_fill": corpus.p8_fill,
        "p9_found": corpus.p9_found, "p9_report": corpus.p9_report, "p9_mix": corpus.p9_mix, "p9_met_report": corpus.p9_met_report, "p9_marginals": corpus.p9_marginals,
        "p10_found": appearance.p10_found, "p10_classes": appearance.p10_classes, "p10_forms": appearance.p10_forms,
    }


def oracle_sql():
    return {
        "p1_found": professors.P1_FOUND_ORACLE,
        "p6_found": duplicates.P6_FOUND_ORACLE,
        "p6_groups": duplicates.P6_GROUPS_ORACLE,
        "p7_found": papers.P7_ORACLE.format(columns="professor_id, paper_id"),
        "p7_selected": papers.P7_ORACLE.format(columns="professor_id, paper_id, complexity_score"),
        "p10_found": appearance.P10_FOUND_ORACLE,
        "p10_classes": appearance.P10_CLASSES_ORACLE,
    }
