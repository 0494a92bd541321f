"""PySpark-native analytics for collections of text documents."""
