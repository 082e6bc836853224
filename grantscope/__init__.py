"""grantscope: a PySpark-native analytics engine for agent authority and security facts."""
