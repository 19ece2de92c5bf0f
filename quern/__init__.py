"""quern: a Spark-native engine for curating and analysing noisy bilingual and multilingual text."""
