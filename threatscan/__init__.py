"""threatscan: Spark-native threat scoring and text forensics over tables and streams."""
