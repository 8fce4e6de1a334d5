"""Training-data operators: licences, line and near-duplicate removal, URL rules, token
counts, packing, toxicity, decontamination and archive audits. Nothing outside this
subpackage imports it; ``__spark_entry__.py`` registers its queries when it is present."""
