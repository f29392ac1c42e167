"""The block coder of operator 2, compiled when it is first needed by the Java compiler that Spark itself generates code with.

A coder takes one step after another, each by what it learnt from those before, so it can't be had from column functions, and
one step at a time is too slow in Python. The class is compiled on the driver and shipped to the executors as a jar in the
shared folder, so executors that join later get it too.

A block's model starts empty. For each id, the id that last followed the two ids before it (order 2) and the one that last
followed the id before it (order 1) are offered first. The chance that an offer is right is mixed, in the logistic domain and
with weights that learn, from how often offers of such confidence were right, how often offers of ids of such frequency in the
block (order 0) were, and how the last offers fared. An offer of order 1 that has not been right
yet is not made. An id that wasn't offered is coded by the frequencies of the block's ids so far
(order 0), and one that is new to the block by the length of its number and its bits. All steps drive one range coder.
"""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import SparkSession

from gleaner.llm.common import shared_folder

PACK, UNPACK = "gleaner_pack_ids", "gleaner_unpack_ids"

SOURCE = r"""
package gleaner.coder;

final class Block {
  static final int[] SQUASH = new int[4096], STRETCH = new int[4096], RATE = new int[64];
  static {
    for (int i = 0; i < 4096; i++) {
      SQUASH[i] = Math.max(48, Math.min(65536 - 48, (int) (65536 / (1 + StrictMath.exp(-(i - 2048) / 256.0)))));
      double p = (i + 0.5) / 4096;
      STRETCH[i] = (int) Math.max(-2047, Math.min(2047, Math.round(256 * StrictMath.log(p / (1 - p)))));
    }
    for (int i = 0; i < 64; i++) RATE[i] = (int) (65536 / (i + 1.6));
  }

  static final int STEP = 24, MOST = 1 << 16, LEAST = 1 << 23;
  final boolean writing;
  byte[] data;
  int at, cache, pending, code, range = 0x7FFFFFFF;  // range and code stay below 2^31
  long low;

  // what the block has taught so far; a place is the number of an id in order of its first occurrence
  int places, total, size = 16, steps, lastNew, fared, p1 = -1, p2 = -1;
  int[] ids, count, tree, next1, sure1, next2, sure2, mark2, slots, keys;
  final int mask;
  final int[] chance = new int[1024], seen = new int[1024], weights = new int[16];

  Block(boolean writing, byte[] data, int at, int n) {
    this.writing = writing;
    this.data = data;
    this.at = at;
    int wide = 16;
    while (wide < 2 * n) wide <<= 1;
    mask = wide - 1;
    ids = new int[Math.min(n + 1, 1024)];
    count = new int[ids.length];
    next1 = new int[ids.length];
    sure1 = new int[ids.length];
    tree = new int[Math.max(17, ids.length * 2 + 1)];
    next2 = new int[wide];
    sure2 = new int[wide];
    mark2 = new int[wide];
    if (writing) { slots = new int[wide]; keys = new int[wide]; }
    java.util.Arrays.fill(chance, 32768);
    java.util.Arrays.fill(weights, 26000);
    if (!writing) for (int i = 0; i < 5; i++) code = code << 8 | next();
  }

  int next() { return at < data.length ? data[at++] & 255 : 0; }

  void put(int b) {
    if (at == data.length) data = java.util.Arrays.copyOf(data, 2 * at + 64);
    data[at++] = (byte) b;
  }

  void shift() {
    range <<= 8;
    if (!writing) { code = code << 8 | next(); return; }
    if (low < 0xFF000000L || low > 0xFFFFFFFFL) {
      int carry = (int) (low >>> 32);
      put(cache + carry);
      for (; pending > 0; pending--) put(255 + carry);
      cache = (int) (low >>> 24) & 255;
    } else pending++;
    low = (low & 0x00FFFFFFL) << 8;
  }

  void close() { for (int i = 0; i < 5; i++) shift(); }

  /** Codes or reads a bit that is 1 with the chance p of 65536. */
  int bit(int y, int p) {
    int bound = (range >>> 16) * p;
    if (!writing) y = code < bound ? 1 : 0;
    if (y == 1) range = bound;
    else {
      range -= bound;
      if (writing) low += bound; else code -= bound;
    }
    while (range < LEAST) shift();
    return y;
  }

  /** A bit with the learnt chance of a context. */
  int bit(int y, int context, int least) {
    y = bit(y, Math.max(64, Math.min(65536 - 64, chance[context])));
    learn(context, y);
    return y;
  }

  void learn(int context, int y) {
    int n = seen[context];
    chance[context] += (int) ((long) ((y << 16) - chance[context]) * RATE[n] >> 16);
    if (n < 62) seen[context] = n + 1;
  }

  /** Narrows the range to a part of it, given in units. */
  void part(int from, int wide, int unit) {
    if (writing) low += (long) unit * from; else code -= unit * from;
    range = unit * wide;
    while (range < LEAST) shift();
  }

  static int log(int x) { return 32 - Integer.numberOfLeadingZeros(x); }

  /** Whether the id is at the place that the given order offers, the chance mixed from three contexts. */
  int offered(int y, int order, int place, int sure) {
    int a = order * 32 + sure, b = 64 + order * 32 + Math.max(0, Math.min(31, 20 + 2 * (log(count[place]) - log(total)) + sure / 4));
    int c = 128 + order * 64 + (fared & 63);
    int sa = STRETCH[chance[a] >> 4], sb = STRETCH[chance[b] >> 4], sc = STRETCH[chance[c] >> 4], w = 4 * order;
    int dot = (int) ((long) weights[w] * sa + (long) weights[w + 1] * sb + (long) weights[w + 2] * sc >> 16);
    int p = SQUASH[Math.max(0, Math.min(4095, dot + 2048))];
    y = bit(y, p);
    int off = (y << 16) - p;
    weights[w] += sa * off >> 14;
    weights[w + 1] += sb * off >> 14;
    weights[w + 2] += sc * off >> 14;
    learn(a, y);
    learn(b, y);
    learn(c, y);
    fared = fared << 1 | y;
    return y;
  }

  int slot(int id) {
    int i = (id * 0x9E3779B1 >>> 7) & mask;
    while (slots[i] != 0 && keys[i] != id) i = (i + 1) & mask;
    return i;
  }

  void add(int place, int n) {
    count[place] += n;
    total += n;
    for (int i = place + 1; i <= size; i += i & -i) tree[i] += n;
  }

  void grow() {
    if (places == ids.length) {
      int n = 2 * places;
      ids = java.util.Arrays.copyOf(ids, n);
      count = java.util.Arrays.copyOf(count, n);
      next1 = java.util.Arrays.copyOf(next1, n);
      sure1 = java.util.Arrays.copyOf(sure1, n);
    }
    if (places == size) {
      size <<= 1;
      if (size >= tree.length) tree = java.util.Arrays.copyOf(tree, 2 * size + 1);
      tree[size] = total;
    }
  }

  void halve() {
    java.util.Arrays.fill(tree, 0);
    total = 0;
    for (int k = 0; k < places; k++) {
      int n = count[k] + 1 >> 1;
      count[k] = 0;
      add(k, n);
    }
  }

  /** What follows a context is offered next time, unless the offer that it would replace has been right more often. */
  static void follow(int[] next, int[] sure, int context, int place) {
    if (next[context] == place + 1) sure[context] = Math.min(sure[context] + 1, 15);
    else {
      sure[context] = sure[context] >> 1;
      if (sure[context] == 0) next[context] = place + 1;
    }
  }

  /** Codes the id, or reads one. */
  int step(int id) {
    int place = -1, found = -1;
    if (writing) {
      int s = slot(id);
      place = slots[s] - 1;
    }
    int h2 = 0, c2 = -1, c1 = -1;
    if (p2 >= 0) {
      int mark = (p2 * 0x85EBCA6B ^ p1) * 0x9E3779B1 | 1;
      h2 = mark >>> 4 & mask;
      if (mark2[h2] != mark) { mark2[h2] = mark; next2[h2] = 0; sure2[h2] = 0; }
      c2 = next2[h2] - 1;
    }
    if (p1 >= 0) c1 = next1[p1] - 1;
    if (c2 >= 0 && offered(place == c2 ? 1 : 0, 0, c2, sure2[h2] * 2 + (c1 == c2 ? 1 : 0)) == 1) found = c2;
    if (found < 0 && c1 >= 0 && c1 != c2 && sure1[p1] > 0 && offered(place == c1 ? 1 : 0, 1, c1, sure1[p1] * 2 + (c2 >= 0 ? 1 : 0)) == 1) found = c1;
    if (found < 0) {
      int fresh = 1;
      if (places > 0) {
        fresh = bit(place < 0 ? 1 : 0, 256 + lastNew * 32 + log(steps), 0);
        lastNew = (lastNew << 1 | fresh) & 3;
      }
      if (fresh == 0) {
        int unit = range / total;
        if (writing) {
          int from = 0;
          for (int i = place; i > 0; i -= i & -i) from += tree[i];
          found = place;
          part(from, count[place], unit);
        } else {
          int v = Math.min(code / unit, total - 1), left = v;
          found = 0;
          for (int half = size >> 1; half > 0; half >>= 1) {  // without branches: goes on behind the half that ends before v
            int sum = tree[found + half], passed = sum - left - 1 >> 31;
            found += half & passed;
            left -= sum & passed;
          }
          part(v - left, count[found], unit);
        }
      } else {
        int length = 1, tall = log(id);
        for (int i = 4; i >= 0; i--) length = length << 1 | bit(tall >> i & 1, 512 + length, 0);
        length -= 32;
        int value = length > 0 ? 1 : 0;
        for (int rest = length - 1; rest > 0; ) {
          int wide = Math.min(rest, 12);
          rest -= wide;
          int unit = range >>> wide, bits = writing ? id >>> rest & (1 << wide) - 1 : Math.min(code / unit, (1 << wide) - 1);
          part(bits, 1, unit);
          value = value << wide | bits;
        }
        grow();
        found = places++;
        ids[found] = value;
        count[found] = 0;
        if (writing) {
          int s = slot(id);
          slots[s] = places;
          keys[s] = id;
        }
      }
    }
    add(found, STEP);
    if (total > MOST) halve();
    if (p2 >= 0) follow(next2, sure2, h2, found);
    if (p1 >= 0) follow(next1, sure1, p1, found);
    p2 = p1;
    p1 = found;
    steps++;
    return ids[found];
  }
}

public class Pack implements org.apache.spark.sql.api.java.UDF3 {
  public Object call(Object ids, Object docs, Object start) {
    byte[] entries = (byte[]) docs;
    java.nio.ByteBuffer from = java.nio.ByteBuffer.wrap((byte[]) ids).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    int n = from.remaining() / 4, head = Unpack.HEAD + entries.length;
    Block block = new Block(true, new byte[head + 2 * n + 64], head, n);
    for (int i = 0; i < n; i++) {
      int id = from.getInt();
      if (id < 0) throw new IllegalArgumentException("ids must be below 2^31");
      block.step(id);
    }
    block.close();
    byte[] out = java.util.Arrays.copyOf(block.data, block.at);
    System.arraycopy(entries, 0, out, Unpack.HEAD, entries.length);
    java.nio.ByteBuffer to = java.nio.ByteBuffer.wrap(out).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    to.putInt(Unpack.MAGIC).putInt(2).putLong(((Long) start).longValue()).putInt(n).putInt(entries.length / 12);
    to.putInt(Unpack.checksum(out));
    return out;
  }
}

public class Unpack implements org.apache.spark.sql.api.java.UDF1 {
  static final int MAGIC = 0x53444947, HEAD = 28;

  static int checksum(byte[] payload) {
    java.util.zip.CRC32 crc = new java.util.zip.CRC32();
    crc.update(payload, 0, HEAD - 4);
    crc.update(payload, HEAD, payload.length - HEAD);
    return (int) crc.getValue();
  }

  public Object call(Object x) {
    byte[] payload = (byte[]) x;
    java.nio.ByteBuffer from = java.nio.ByteBuffer.wrap(payload).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    if (payload.length < HEAD || from.getInt() != MAGIC || from.getInt() != 2) throw new IllegalArgumentException("not a block of ids");
    long start = from.getLong();
    int n = from.getInt(), docs = from.getInt();
    if (from.getInt() != checksum(payload)) throw new IllegalArgumentException("damaged block: the checksum of the one at id " + start + " of its part is wrong");
    Block block = new Block(false, payload, HEAD + 12 * docs, n);
    java.nio.ByteBuffer to = java.nio.ByteBuffer.allocate(4 * n).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    for (int i = 0; i < n; i++) to.putInt(block.step(0));
    return to.array();
  }
}
"""


def _jar(classes: dict[str, bytes]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, code in sorted(classes.items()):
            z.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), code)
    return held.getvalue()


def register(spark: SparkSession) -> None:
    """Makes the SQL functions PACK(ids, documents, start) and UNPACK(payload) known to the session."""
    jvm, context = spark._jvm, spark.sparkContext
    loaded = getattr(context, "_gleaner_coder", None)
    if loaded is None:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(SOURCE)
        codes = compiler.getBytecodes()
        jar = _jar({name: bytes(codes[name]) for name in codes})
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark, 'coder')}/coder_{zlib.crc32(jar):08x}.jar")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(jar))
        out.close()
        context._jsc.addJar(path.toString())
        loaded = context._gleaner_coder = compiler.getClassLoader()
    binary = jvm.org.apache.spark.sql.types.DataTypes.BinaryType
    for name, kind in ((PACK, "Pack"), (UNPACK, "Unpack")):
        spark._jsparkSession.udf().register(name, loaded.loadClass(f"gleaner.coder.{kind}").newInstance(), binary)
