"""graphloom: code-security and corpus analytics as PySpark DataFrame operators."""
