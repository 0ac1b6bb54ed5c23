"""Stages of the pipeline on their edges: no labels, whole private keys."""

import random

import pyarrow as pa

import corpus_pipeline
from stratalog.llm import secrets, toxicity

from .test_operators import labelled, plain_secrets, table


def test_all_rows_stay_without_labels(spark):
    docs, labels, truth = labelled(spark, 12)
    held = labels.filter(toxicity.held_out(labels.doc_id))
    for none in (labels.limit(0), labels.filter("doc_id = 1000000"), held):
        assert toxicity.drop_toxic(docs, none).count() == len(truth)


def key_body(n=9):
    rnd = random.Random(41)
    line = lambda k: "".join(rnd.choice("ABCXYZabcxyz0189+/") for _ in range(k))
    return [*(line(64) for _ in range(n)), line(18) + "=="]


def test_whole_private_keys(spark):
    head, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", key_body()
    lines = "\n".join(body)
    told = {
        f"é {head}\n{lines}\n{end}\nafter": "é [SECRET]\nafter",
        f"a {head}\r\n" + "\r\n".join(body) + "\r\nPlain words follow.": "a [SECRET]\r\nPlain words follow.",
        f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{lines}": "[SECRET]",
        f'k = "{head}\\n' + "\\n".join(body) + f'\\n{end}\\n"': 'k = "[SECRET]\\n"',
        f"{head}\n{lines}\n{head}\n{lines}\n{end} x": "[SECRET]\n[SECRET] x",
        f"{head} is how a key begins\nand more": "[SECRET] is how a key begins\nand more",
        f"{head}\n{lines}\n-----END EC PRIVATE KEY-----": "[SECRET]\n-----END EC PRIVATE KEY-----",
    }
    docs = table(spark, list(told))
    assert [r.text for r in corpus_pipeline.secrets.redact(docs).orderBy("doc_id").collect()] == list(told.values())
    found = secrets.scan_texts(pa.array(list(told)), secrets.automaton())
    assert all([s for s in found[i] if s[2] in secrets.KINDS[:3]] == plain_secrets(t) for i, t in enumerate(told))
    assert secrets._keys(b"-----BEGIN PRIVATE KEY-----\n" * 20_000, [28 * k + 11 for k in range(20_000)], [])[-1][2] == "pem"
