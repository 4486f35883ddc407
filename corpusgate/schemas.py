"""Schemas of every table, as Spark DDL. Readers use them; nothing is inferred."""

NOTES = ("deck STRING, nid BIGINT, guid STRING, mid BIGINT, mod BIGINT, usn INT, tags STRING, "
         "flds STRING, sfld STRING, csum BIGINT, flags INT, data STRING")
CARDS = ("deck STRING, id BIGINT, nid BIGINT, did BIGINT, ord INT, mod BIGINT, usn INT, type INT, "
         "queue INT, due BIGINT, ivl INT, factor INT, reps INT, lapses INT, left INT, odue INT, "
         "odid INT, flags INT, data STRING")
DECKS = "deck STRING, did BIGINT, name STRING"
NOTETYPES = "deck STRING, mid BIGINT, name STRING, mtime_secs BIGINT, usn INT, config BINARY"
NOTES7 = ("deck STRING, nid BIGINT, text STRING, extra STRING, personal STRING, custom STRING, "
          "missed STRING, textbook STRING, resources STRING, tags STRING, sfld STRING, csum BIGINT")
CLAIM = ("deck STRING, nid BIGINT, field STRING, subject STRING, attribute STRING, value STRING, "
         "unit STRING, span STRUCT<lo: DOUBLE, hi: DOUBLE>, kind STRING, xref BOOLEAN, "
         "sent STRING")
BASELINE = "subject STRING, attribute STRING"
FINGERPRINT = "deck STRING, nid BIGINT, nums ARRAY<STRING>, terms ARRAY<STRING>"
TOPIC = ("topic STRING, n_cards BIGINT, n_decks BIGINT, decks ARRAY<STRING>, "
         "cards ARRAY<STRUCT<deck: STRING, nid: BIGINT, text: STRING>>")
SNAPSHOT = "kind STRING, item STRING, deck STRING, n BIGINT"
OPS = ("op_seq BIGINT, nid BIGINT, op STRING, field INT, find STRING, replace STRING, "
       "text STRING, extra STRING, into ARRAY<STRUCT<text: STRING, extra: STRING>>, "
       "into_nid BIGINT, facts ARRAY<STRING>, fact STRING, why STRING, drop_tail BOOLEAN, "
       "drop_media BOOLEAN")
NEW_NOTES = "seq BIGINT, text STRING, extra STRING"
CHANGELOG = "run_id STRING, seq BIGINT, kind STRING, nid BIGINT, reason STRING"
LEDGER = "nid BIGINT, flags ARRAY<STRING>, n_flags INT, len_text INT, len_extra INT"
WORD_BOXES = "page_id STRING, text STRING, conf DOUBLE, l INT, t INT, w INT, h INT"
PAGE_STATS = ("page_id STRING, page_w INT, page_h INT, page_tokens BIGINT, sheet_tokens BIGINT, "
              "numbers_tokens BIGINT, bands INT, num_bands INT, band_px BIGINT, words_total BIGINT, "
              "words_low_conf BIGINT, words_numeric BIGINT, informative_ink_px BIGINT, "
              "furniture_px BIGINT, furniture_frac DOUBLE, unaccounted_ink_px BIGINT")
PAGE_TEXT = "doc STRING, page STRING, text STRING"
MODULES = ("name STRING, deck_id BIGINT, status STRING, date STRING, cards_before BIGINT, "
           "cards_after BIGINT, added BIGINT, edited BIGINT, outstanding ARRAY<STRING>, "
           "gaps_filled ARRAY<STRING>")
QUEUE = ("name STRING, deck_id BIGINT, deck_path STRING, apkg STRING, pdf STRING, mode STRING, "
         "cards_before BIGINT, status STRING")
REPORTS = "module STRING, report STRING"
PROGRESS = "module STRING, last_index BIGINT, total BIGINT, complete BOOLEAN, _corrupt STRING"
SESSION_LOG = "run BIGINT, date STRING, module STRING, summary STRING"
FILES = "path STRING, sha256 STRING"
SECTIONS = "path STRING, ord INT, heading STRING, body STRING"
