"""weftline: dataflow jobs, text statistics, audits and integer machine learning as Spark plans."""
