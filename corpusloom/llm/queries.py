"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from . import ann, annulus, chat, fingerprints, katz, licences, mixing, near, packing, personal, quality, treaps, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_katz": katz.query,
    "op3_near": near.query,
    "op4_licences": licences.query,
    "op5_warc": warc.query,
    "op6_fingerprints": fingerprints.query,
    "op7_packing": packing.query,
    "op8_mixing": mixing.query,
    "op9_inner_product": ann.query,
    "op10_chat": chat.query,
    "op11_treaps": treaps.query,
    "op12_personal_data": personal.query,
    "op13_annulus": annulus.query,
}
ORACLES = {"op8_mixing": mixing.SQL, "op11_treaps": treaps.SQL, "op13_annulus": annulus.oracle()}
