"""Spark-native text analytics: segmentation, n-gram statistics, language models and crawl scoring."""
