"""Source texts for tests."""

NEAR_A = """def mean_depth(readings):
    # readings of one buoy, in metres
    good = [r for r in readings if r > 0]
    if not good:
        return None
    return sum(good) / len(good)


print(mean_depth([3.5, 0, 4.25, -1]))"""

NEAR_B = """def mean_depth(readings):
    good = [r for r in readings if r > 0]
    if not good:
        return None
    # leave out what the buoy could not measure
    return sum(good) / len(good)


print(mean_depth([3.5, 0, 4.25, -1]))"""

PYTHON = '''import os
from x import y

class Store:
    def add(self, item, extra=(1, 2)):
        """Adds
        an item."""
        if item:
            for i in range(3):
                print(i)
        elif extra:
            pass
        else:
            x = 1 if extra else 2

        try:
            z = lambda q: q
        except KeyError:
            pass
        while True:
            break

    async def names(self):
        return [i for i in self.all if i]
'''

JAVA = '''/**
 * Adds numbers.
 */
public class Adder {
    public static int addAll(int[] numbers, int start) {
        if (numbers == null) {
            throw new IllegalArgumentException("none {");
        }
        int total = start;
        for (int n : numbers) {
            total += n;
        }
        do { total--; } while (total > 100);
        if (total < 0) return 0; else if (total == 1) { return 1; }
        return total;
    }
}
'''

JAVASCRIPT = '''import a from "b";
function average(numbers, b) {
    if (!numbers) {
        throw new Error("{");
    }
    const total = numbers.reduce((acc, val) => acc + val, 0);
    items.forEach(function(x) { for (let i = 0; i < 3; i++) { use(i); } });
    return total / numbers.length;
}
class A { bar(x) { while (x) x--; } }
'''

GO = '''package main
import "fmt"
func (r T) name(a int, b int) int {
	for i := 0; i < 3; i++ {
		if i > 1 { fmt.Println(i) }
	}
	f := func(x int) int { return x }
	return f(1)
}
type P struct { x int }
'''

RUST = '''use std::io;
struct P { x: i32 }
impl P {
    fn new(x: i32, y: &'a str) -> P {
        let c = |v| v + 1;
        match x { 1 => {}, _ => {} }
        while x > 1 { if x == 'c' { break; } }
        for i in 0..3 { println!("{}", i); }
    }
}
'''

RUBY = '''class Foo
  def bar(a, b)
    if a
      puts a
    end
    x = if b then 1 else 2 end
    return 1 if b
    [1].each do |z|
      puts z
    end
    while a do
      a -= 1
    end
  end
end
'''

C = '''#include <stdio.h>
struct point { int x; };
int add(int a, struct point b) {
    if (a > 0) {
        for (int i = 0; i < a; i++) printf("%d", i);
    }
    while (a) a--;
    return a;
}
'''

CPP = '''#include <vector>
using namespace std;
class Box {
public:
    int size(int a) const { try { return a; } catch (...) { return 0; } }
};
int main() { auto f = [&](int x) { return x; }; return f(1); }
'''

TYPESCRIPT = '''interface Shape { area: number }
class Square {
  side: number = 1;
  area(): number { if (this.side) { return this.side; } return 0; }
}
function twice(x: number): number { return x * 2; }
'''

# role -> number of constructs, counted by hand
ROLES = {
    "python": (PYTHON, dict(function=2, class_=1, if_=1, for_=1, while_=1, try_=1, import_=2, lambda_=1)),
    "java": (JAVA, dict(function=1, class_=1, if_=3, for_=1, while_=0, try_=0, import_=0, lambda_=0)),
    "javascript": (JAVASCRIPT, dict(function=4, class_=1, if_=1, for_=1, while_=1, try_=0, import_=1, lambda_=1)),
    "go": (GO, dict(function=1, class_=1, if_=1, for_=1, while_=1, try_=0, import_=1, lambda_=1)),
    "rust": (RUST, dict(function=1, class_=2, if_=1, for_=1, while_=1, try_=1, import_=1, lambda_=1)),
    "ruby": (RUBY, dict(function=1, class_=1, if_=2, for_=0, while_=1, try_=0, import_=0, lambda_=0)),
    "c": (C, dict(function=1, class_=2, if_=1, for_=1, while_=1, try_=0, import_=1, lambda_=0)),
    "cpp": (CPP, dict(function=2, class_=1, if_=0, for_=0, while_=0, try_=1, import_=1, lambda_=1)),
}
