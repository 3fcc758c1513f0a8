"""A PySpark-native engine for triaging reported e-mail at scale."""
