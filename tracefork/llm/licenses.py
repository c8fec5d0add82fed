"""License scans by sentence rules: normalised sentences become identifiers, identifier sequences match licence rules.

Built-in functions only. A text is cut into sentences twice, once with line ends as borders and once without, so that
both one-line notices and wrapped licence texts are read. Texts with a word of a known sentence are read twice more with
carriage returns and comment marks taken off: again by the borders of wrapped texts, and with borders that leave
sentences with colons, semicolons and "v. 2" whole, as in the headers of the GPL and the MPL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefork.functions.arrays import let
from tracefork.llm.tables import free_name

#: Sentences of public licences and of the notices that name them, normalised (see ``normalised``).
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-title": ["mit license", "the mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd-head": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-nc-4-notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4-notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4-notice": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

#: Ordered rules; a matched sequence is consumed, so a longer licence comes before one that it contains.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-warranty"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
]

BORDERS = r"[.!?:;]+[ \t\n]+|\n+"
NOT_ALNUM = r"[^a-z0-9]+"
WRAPPED = r"[.!?:;]+[ \t\n]+|\n[ \t]*\n"
HEADER = r"(?<!\b[vV])[.!?]+[ \t\n]+|\n[ \t]*\n"
#: What stands before the words of a line; ``d``: only a line feed ends lines.
LINE_START = r"(?md)^(?:[^A-Za-z0-9\n]+|(?:dnl|REM|rem)\b)+"
#: Every known sentence has one of these.
SIGNS = r"(?i)licen|permission|redistribut|software|warranty"


def sentence_ids() -> dict[str, str]:
    return {sentence: name for name, known in SENTENCES.items() for sentence in known}


def normalised(sentence: Column) -> Column:
    """Lower case; whatever is neither ASCII letter nor digit becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_ALNUM, " "))


def known_sentences(text: Column, borders: str) -> Column:
    """Identifiers of the known sentences in their order."""
    known = sentence_ids()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    longest = max(map(len, known))
    found = F.filter(F.transform(F.split(text, borders), normalised), lambda s: (F.length(s) <= longest) & (s != ""))
    return let(table, lambda m: F.filter(F.transform(found, lambda s: F.try_element_at(m, s)), lambda i: i.isNotNull()))


def unmarked(text: Column) -> Column:
    """Line feeds as line ends, and lines without what comment marks, boxes or quoting put before their words."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), LINE_START, "")


def matched_in_headers(text: Column) -> Column:
    """Licences of the text without marks, in the order of the two readings and their rules."""
    names = let(unmarked(text), lambda t: F.array_union(*(matched_rules(known_sentences(t, b)) for b in (WRAPPED, HEADER))))
    return F.when(text.rlike(SIGNS), names).otherwise(F.array().cast("array<string>"))


def matched_rules(ids: Column) -> Column:
    """Licences whose rules match, each once, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f",{',,'.join(seq)},").alias("ids")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["ids"])
        return F.struct(
            F.replace(acc["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(hit, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"),
        )

    return F.aggregate(rules, start, step, lambda acc: acc["names"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``license_scan``: ``sentences`` (identifiers in their order, cut at line ends),
    ``licenses`` (sorted names) and ``license`` (the first of them by the order of the rules, null if none).

    Null and empty texts have no licence. Rows don't depend on each other. The column gets a trailing underscore where
    ``docs`` has one of its name.
    """
    name = free_name(docs, "license_scan")
    text = F.coalesce(F.col("text"), F.lit(""))
    scan = let(
        text,
        lambda t: let(
            known_sentences(t, BORDERS),
            lambda by_line: let(
                F.array_union(
                    F.array_union(matched_rules(by_line), matched_rules(known_sentences(t, WRAPPED))), matched_in_headers(t)
                ),
                lambda names: F.struct(
                    by_line.alias("sentences"),
                    F.array_sort(names).alias("licenses"),
                    F.get(names, F.lit(0)).alias("license"),
                ),
            ),
        ),
    )
    return docs.withColumn(name, scan)


def license_sql() -> str:
    """The scan of ``documents`` in SQL, from the same two tables: the first two readings only."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in sentence_ids().items())
    # `ids` has the sentences wrapped in commas; a rule that matched is replaced, so the next one sees the rest only.
    steps, last = [], "ids"
    for n, (_, seq) in enumerate(RULES):
        ids = quoted(f",{',,'.join(seq)},")
        steps.append(f"s{n} AS (SELECT *, replace(r{n}, {ids}, '|') AS r{n + 1} FROM {'s' + str(n - 1) if n else 'joined'})")
    names = ", ".join(f"CASE WHEN r{n} <> r{n + 1} THEN {quoted(name)} END" for n, (name, _) in enumerate(RULES))
    order = ", ".join(quoted(n) for n in dict.fromkeys(n for n, _ in RULES))
    last = f"s{len(RULES) - 1}"

    def cut(view: str, borders: str) -> str:
        return (
            f"SELECT doc_id, {view} AS kind, place, trim(regexp_replace(lower(s), '{NOT_ALNUM}', ' ', 'g')) AS s FROM ("
            f"SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM ("
            f"SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{borders}') AS parts FROM documents))"
        )

    return f"""
WITH known(s, id) AS (VALUES {known}),
cut AS ({cut('0', BORDERS)} UNION ALL {cut('1', WRAPPED)}),
found AS (SELECT doc_id, kind, place, id FROM cut JOIN known USING (s)),
joined AS (SELECT doc_id, kind, count(*) AS n, ',' || string_agg(id, ',,' ORDER BY place) || ',' AS r0 FROM found GROUP BY doc_id, kind),
{', '.join(steps)},
named AS (SELECT doc_id, kind, unnest([{names}]) AS name FROM {last}),
per_doc AS (
  SELECT doc_id, list_sort(list(DISTINCT name)) AS names, arg_min(name, kind * 1000 + list_position([{order}], name)) AS license
  FROM named WHERE name IS NOT NULL GROUP BY doc_id
),
counted AS (SELECT doc_id, n FROM joined WHERE kind = 0)
SELECT d.doc_id, coalesce(c.n, 0) AS n_sentences, coalesce(array_to_string(p.names, ','), '') AS licenses, p.license
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id
"""
